"""Merging versions of the same rows: last write wins, with tombstones and time to live.

Times are microseconds, ``now`` is always given. The versions of a key are long: one row each with

    generation, write_time, ttl (microseconds or null), tombstone (boolean), deletion_time (of a tombstone), value columns

A tombstone with a ttl stops to count when deletion_time + ttl is over. All windows of an operator share one PARTITION BY, so
each costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def active(now: int) -> Column:
    """A tombstone that still counts."""
    return F.col("tombstone") & (F.col("ttl").isNull() | (F.lit(now) <= F.col("deletion_time") + F.col("ttl")))


def live(now: int, write_time: str = "write_time", ttl: str = "ttl") -> Column:
    """A value whose time to live is not over."""
    return F.col(ttl).isNull() | (F.lit(now) <= F.col(write_time) + F.col(ttl))


def merge_generations(versions: DataFrame, key: list[str], now: int, tiebreak: list[str] = ()) -> DataFrame:
    """The surviving version of each key (M1).

    The newest active tombstone removes values written at or before it. Of the rest the first by generation, then write time,
    both descending, is the key's version; it is absent if that is the tombstone or its time to live is over.
    """
    w = Window.partitionBy(*key)
    first = w.orderBy(F.desc("generation"), F.desc("write_time"), *[F.asc(c) for c in tiebreak])
    marked = versions.withColumn("__act", active(now))
    marked = marked.withColumn("__t", F.max(F.when(F.col("__act"), F.col("deletion_time"))).over(w))
    kept = marked.filter(F.col("__act") & (F.col("deletion_time") == F.col("__t")) | ~F.col("tombstone") & (F.col("__t").isNull() | (F.col("write_time") > F.col("__t"))))
    top = kept.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1")
    return top.filter(~F.col("tombstone") & live(now)).drop("__act", "__t", "__rank")


def drop_row_deleted(cells: DataFrame, row_key: list[str], now: int, is_row_tombstone: str = "row_tombstone") -> DataFrame:
    """Cells that no row tombstone of their row covers; the tombstones themselves go (first half of M2)."""
    w = Window.partitionBy(*row_key)
    t = F.max(F.when(F.col(is_row_tombstone) & active(now), F.col("deletion_time"))).over(w)
    at = F.when(F.col("tombstone"), F.col("deletion_time")).otherwise(F.col("write_time"))
    return cells.withColumn("__t", t).filter(~F.col(is_row_tombstone) & (F.col("__t").isNull() | (at > F.col("__t")))).drop("__t")


def merge_cells(cells: DataFrame, row_key: list[str], now: int, column: str = "column", tiebreak: list[str] = ()) -> DataFrame:
    """Each cell's surviving version (M3): M1 for every column of every row by itself."""
    return merge_generations(cells, [*row_key, column], now, tiebreak)


def merge_rows(cells: DataFrame, row_key: list[str], now: int, column: str = "column", tiebreak: list[str] = ()) -> DataFrame:
    """Row tombstones first, then each cell (M2)."""
    return merge_cells(drop_row_deleted(cells, row_key, now), row_key, now, column, tiebreak)


def pivot_cells(cells: DataFrame, row_key: list[str], columns: list[str], column: str = "column", value: str = "value") -> DataFrame:
    """Merged cells as rows, a column for each of the named ones."""
    return cells.groupBy(*row_key).agg(*[F.max(F.when(F.col(column) == c, F.col(value))).alias(c) for c in columns])


def apply_range_tombstones(rows: DataFrame, tombstones: DataFrame, partition_key: list[str], clustering: str, now: int, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows that no range tombstone covers (M4).

    ``tombstones`` has the partition key, range_start, range_end, deletion_time and ttl. Both ends are included, a missing one
    is open, and with both missing it covers nothing; it deletes what was written before it. Tombstones are counted first: few
    are sent to all tasks, many meet the rows by a shuffle on the partition key.
    """
    t = tombstones.filter((F.col("range_start").isNotNull() | F.col("range_end").isNotNull()) & (F.col("ttl").isNull() | (F.lit(now) <= F.col("deletion_time") + F.col("ttl"))))
    t = t.select(*[F.col(k).alias(f"__{k}") for k in partition_key], "range_start", "range_end", F.col("deletion_time").alias("__deleted"))
    if t.limit(broadcast_rows + 1).count() <= broadcast_rows:
        t = F.broadcast(t)
    inside = (F.col("range_start").isNull() | (F.col(clustering) >= F.col("range_start"))) & (F.col("range_end").isNull() | (F.col(clustering) <= F.col("range_end")))
    on = inside & (F.col("__deleted") > F.col("write_time"))
    for k in partition_key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return rows.join(t, on, "left_anti")


def drop_expired(rows: DataFrame, now: int) -> DataFrame:
    """Rows whose time to live is not over (M5)."""
    return rows.filter(live(now))


def resolve_conflicts(versions: DataFrame, key: list[str], now: int) -> DataFrame:
    """The version of greatest write time, unless that is a tombstone or expired (M6). A tombstone's time is its deletion; on a tie it wins."""
    at = F.when(F.col("tombstone"), F.col("deletion_time")).otherwise(F.col("write_time"))
    others = [c for c in versions.columns if c not in key]
    best = versions.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(at, F.col("tombstone"), F.col("generation"))).alias("__best"))
    rows = best.select(*key, "__best.*").select(*versions.columns)
    return rows.filter(~F.col("tombstone") & live(now))


def collectable_tombstones(versions: DataFrame, now: int, gc_grace_seconds: int) -> DataFrame:
    """Tombstones older than the grace period (M8)."""
    return versions.filter(F.col("tombstone") & (F.lit(now) - F.col("deletion_time") > gc_grace_seconds * 1_000_000))


def merge_collections(versions: DataFrame, key: list[str], now: int, value: str, removed: str, is_map: bool = False) -> DataFrame:
    """The newest collection of each key without its removed elements, or keys (M9); none if an active tombstone is newest."""
    top = resolve_conflicts(versions, key, now)
    gone = F.coalesce(F.col(removed), F.array())
    if is_map:
        kept = F.map_filter(F.col(value), lambda k, v: ~F.array_contains(gone, k))
    else:
        kept = F.filter(F.col(value), lambda v: ~F.array_contains(gone, v))
    return top.withColumn(value, F.when(F.size(gone) > 0, kept).otherwise(F.col(value)))


def merge_counters(deltas: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """Counters: the sum of all deltas of a key."""
    return deltas.groupBy(*key).agg(*[F.sum(c).alias(c) for c in columns])
