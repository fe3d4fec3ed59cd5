"""Operators that know a table's partition and clustering keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.errors import QueryProblem
from lamina.schema import TableSpec


def clustering_order(spec: TableSpec, columns: list[str] | None = None) -> list[Column]:
    """The sort of rows inside a partition, each clustering column in its own direction."""
    return [F.col(k).desc_nulls_last() if spec.column(k).descending else F.col(k).asc_nulls_first() for k in columns or spec.clustering_key]


def per_partition_limit(df: DataFrame, spec: TableSpec, n: int) -> DataFrame:
    """The first n rows of each partition in clustering order. Spark cuts each task's share to n rows before the shuffle."""
    if n == 0:
        return df.filter(F.lit(False))
    order = clustering_order(spec) or [F.lit(0)]
    w = Window.partitionBy(*spec.partition_key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def partition_scan(df: DataFrame, spec: TableSpec, key: dict) -> DataFrame:
    """All rows of one partition in clustering order. The equalities reach the Parquet scan."""
    if missing := [k for k in spec.partition_key if k not in key]:
        raise QueryProblem(f"no value for partition key column {missing[0]}")
    for k in spec.partition_key:
        df = df.filter(F.col(k) == F.lit(key[k]))
    return df.orderBy(*clustering_order(spec)) if spec.clustering_key else df


def point_get(df: DataFrame, spec: TableSpec, key: dict) -> DataFrame:
    """The row of a full key, if there is one."""
    for k in spec.key:
        if k not in key:
            raise QueryProblem(f"no value for key column {k}")
        df = df.filter(F.col(k) == F.lit(key[k]))
    return df


def clustering_range(df: DataFrame, spec: TableSpec, key: dict, low: tuple | None = None, high: tuple | None = None) -> DataFrame:
    """Rows of a partition between two clustering prefixes, ends included, in clustering order.

    A bound is a prefix of clustering values; ascending and descending columns may mix, so a bound is written out column by
    column, which the scan can use, and not as a comparison of structs.
    """
    rows = partition_scan(df, spec, key)
    for bound, after in ((low, True), (high, False)):
        if bound is not None:
            rows = rows.filter(_beyond(spec, bound, after))
    return rows


def _beyond(spec: TableSpec, bound: tuple, after: bool) -> Column:
    out: Column | None = None
    for i in reversed(range(len(bound))):
        c, v = F.col(spec.clustering_key[i]), F.lit(bound[i])
        up = after != spec.column(spec.clustering_key[i]).descending
        strict, same = (c > v if up else c < v), c == v
        out = strict | same & (out if out is not None else F.lit(True))
    if out is None:
        raise QueryProblem("an empty bound")
    return out


def latest_per_key(df: DataFrame, key: list[str], *newest: str) -> DataFrame:
    """One row of each key, that with the greatest ``newest`` columns: one shuffle, with partial maxima before it."""
    others = [c for c in df.columns if c not in key]
    order = [*newest, *[c for c in others if c not in newest]]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("__best")) if not _orderable(df, order) else df.groupBy(*key).agg(F.max(F.struct(*order)).alias("__best"))
    return best.select(*key, *[F.col(f"__best.{c}").alias(c) for c in others]).select(*df.columns)


def _orderable(df: DataFrame, columns: list[str]) -> bool:
    return not any("map<" in df.schema[c].dataType.simpleString() for c in columns)


def spread_statics(df: DataFrame, spec: TableSpec, statics: list[str] | None = None) -> DataFrame:
    """Static columns with their partition's value in every row: the last one written, by clustering order."""
    w = Window.partitionBy(*spec.partition_key).orderBy(*(clustering_order(spec) or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in statics or spec.statics})


def clustered(df: DataFrame, spec: TableSpec, partitions: int | None = None) -> DataFrame:
    """Rows dealt out by partition key and sorted by clustering order: how a table is laid out for writing."""
    keys = [F.col(k) for k in spec.partition_key]
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *clustering_order(spec))


def token_range(df: DataFrame, spec: TableSpec, low: int, high: int) -> DataFrame:
    """Rows whose partition's token lies in (low, high]: disjoint ranges divide a table among readers."""
    t = F.xxhash64(*spec.partition_key)
    return df.filter((t > low) & (t <= high))
