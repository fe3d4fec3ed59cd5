"""Which generations to merge, and merging them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.reconcile import active, live


@dataclass(frozen=True)
class Generation:
    number: int
    size_bytes: int
    newest: int = 0


def choose(generations: list[Generation], strategy: str = "size_tiered", least: int = 4, level_bytes: int = 10 << 20, window_tables: int = 24) -> list[Generation]:
    """The generations to merge next.

    size_tiered: the two oldest once there are more than ``least``; leveled: all once they hold more than ``level_bytes``;
    time_window: the two oldest once there are more than ``window_tables``.
    """
    by_age = sorted(generations, key=lambda g: g.number)
    if strategy == "size_tiered":
        return by_age[:2] if len(by_age) > least else []
    if strategy == "leveled":
        return by_age if len(by_age) > 1 and sum(g.size_bytes for g in by_age) > level_bytes else []
    if strategy == "time_window":
        return by_age[:2] if len(by_age) > window_tables else []
    raise ValueError(f"unknown strategy {strategy}")


def union_generations(generations: dict[int, DataFrame]) -> DataFrame:
    """All generations as one, each row with its generation; columns that some lack are null there."""
    out = None
    for number, df in sorted(generations.items()):
        df = df.withColumn("generation", F.lit(number))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no generations")
    return out


def compact(versions: DataFrame, key: list[str], now: int, gc_grace_seconds: int = 864_000, whole: bool = True) -> DataFrame:
    """One version a key: the newest that counts, dead values and collectable tombstones dropped.

    A tombstone stays while it is younger than the grace period, or if generations outside this merge (``whole`` false) might
    hold what it deletes. One shuffle: the newest is a maximum with partial maxima before it.
    """
    at = F.when(F.col("tombstone"), F.col("deletion_time")).otherwise(F.col("write_time"))
    others = [c for c in versions.columns if c not in key]
    counted = versions.filter(~F.col("tombstone") | active(now))
    best = counted.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(at, F.col("tombstone"), F.col("generation"))).alias("__best"))
    rows = best.select(*key, "__best.*").select(*versions.columns)
    old = F.lit(now) - F.col("deletion_time") > gc_grace_seconds * 1_000_000
    return rows.filter(F.when(F.col("tombstone"), ~old if whole else F.lit(True)).otherwise(live(now)))
