"""Statistics of tables and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_stats(df: DataFrame, partition_key: list[str] = (), write_time: str | None = None) -> DataFrame:
    """One row: rows, and with a key the number of partitions and the rows of the largest, with a write time its range."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if write_time:
        aggs += [F.min(write_time).alias("first_write"), F.max(write_time).alias("last_write")]
    if not partition_key:
        return df.agg(*aggs)
    per = df.groupBy(*partition_key).agg(*aggs)
    more = [F.min("first_write").alias("first_write"), F.max("last_write").alias("last_write")] if write_time else []
    return per.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_partitions"), F.max("n_rows").alias("largest_partition"), *more)


def column_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """A row for each column: rows, nulls, distinct values, least and greatest as text. One pass; distinct values are estimated unless ``exact``."""
    simple = [f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
    chosen = [c for c in columns or simple if c in simple]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for k, c in enumerate(chosen):
        q = F.col(f"`{c}`")
        aggs += [F.count(q).alias(f"__c{k}"), (F.count_distinct(q) if exact else F.approx_count_distinct(q)).alias(f"__d{k}"), F.min(q).cast("string").alias(f"__a{k}"), F.max(q).cast("string").alias(f"__b{k}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col("__n").alias("n_rows"), (F.col("__n") - F.col(f"__c{k}")).alias("n_null"), F.col(f"__d{k}").alias("n_distinct"), F.col(f"__a{k}").alias("least"), F.col(f"__b{k}").alias("greatest")) for k, c in enumerate(chosen)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(x, y): centres and heights of a histogram of a number."""
    return df.agg(F.histogram_numeric(column, F.lit(bins)).alias("h")).select(F.explode("h").alias("h")).select("h.x", "h.y")


def count_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of several inputs together: counted in each, then summed."""
    counts = [f.agg(F.count(F.lit(1)).alias("n")) for f in frames]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n"))
