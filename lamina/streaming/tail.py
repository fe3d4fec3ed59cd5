"""Generations as a stream: what arrives is merged into the latest state, and aggregated over windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lamina.operators.compaction import compact


def read_generations(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files under a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(folder)


def upsert(stream: DataFrame, key: list[str], state: str, checkpoint: str, now: int | None = None, gc_grace_seconds: int = 864_000, once: bool = True) -> StreamingQuery:
    """Keep the merged versions of all keys under ``state``: each batch is merged with the last state and written beside it.

    A batch that is run again after a failure writes the same folder again, so each version counts once. Readers take the
    highest numbered folder, by ``latest``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _folders(spark, state)
        base = max((n for n in old if n < number), default=None)
        rows = batch.withColumn("generation", F.coalesce(F.col("generation"), F.lit(number))) if "generation" in batch.columns else batch.withColumn("generation", F.lit(number))
        if base is not None:
            rows = spark.read.parquet(f"{state}/batch-{base}").unionByName(rows, allowMissingColumns=True)
        at = now if now is not None else int(batch.sparkSession.sql("SELECT unix_micros(current_timestamp())").first()[0])
        compact(rows, key, at, gc_grace_seconds).write.mode("overwrite").parquet(f"{state}/batch-{number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def _folders(spark: SparkSession, state: str) -> list[int]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[6:]) for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("batch-"))


def latest(spark: SparkSession, state: str) -> DataFrame:
    """The state after the last finished batch, tombstones left out."""
    numbers = [n for n in _folders(spark, state)]
    if not numbers:
        raise ValueError(f"no state under {state}")
    return spark.read.parquet(f"{state}/batch-{numbers[-1]}").filter(~F.col("tombstone"))


def arrived(out: DataFrame, mode: str, folder: str, checkpoint: str) -> DataFrame:
    """What a stream gives once all that is there has arrived: each batch is a folder of files, so no row passes through the driver.

    In mode append the rows of all batches, in mode complete those of the last one, whose predecessors are deleted. A batch that
    is run again after a failure writes the same folder again.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        if mode == "complete":
            for old in _folders(batch.sparkSession, folder):
                if old < number:
                    path = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch-{old}")
                    path.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    spark = out.sparkSession
    out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    numbers = _folders(spark, folder)
    if not numbers:
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(*[f"{folder}/batch-{n}" for n in (numbers[-1:] if mode == "complete" else numbers)])


def windowed(stream: DataFrame, time: str, width: str, keys: list[str] = (), value: str | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts, and sums of a value, over tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = stream.withWatermark(time, late).groupBy(w, *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["total"] if value else []))


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows of a key with less than ``gap`` between them, as sessions."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def live_only(stream: DataFrame, ttl_seconds: int, time: str) -> DataFrame:
    """Rows whose time to live is not over when they are read."""
    return stream.filter(F.col(time) + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS") >= F.current_timestamp())
