"""Files to DataFrames."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.errors import QueryProblem

FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".orc": "orc", ".avro": "avro", ".txt": "text"}
_NUMBERED = re.compile(r"(?:^|[/\\])(?:gen|generation)[-_=]?(\d+)", re.I)


def detect_format(path: str) -> str:
    """The format by the file's name, compression endings left aside."""
    name = os.path.basename(path.rstrip("/")).lower()
    for ending in (".gz", ".zst", ".snappy", ".lz4", ".bz2"):
        name = name.removesuffix(ending)
    out = FORMATS.get(os.path.splitext(name)[1])
    if out is None:
        raise QueryProblem(f"the format of {path} can't be told from its name")
    return out


def read(spark: SparkSession, *paths: str, schema: T.StructType | None = None, format: str | None = None, **options) -> DataFrame:
    """One or several files of a format as one DataFrame. CSV and JSON without a schema cost a pass to infer it."""
    kind = format or detect_format(paths[0])
    reader = spark.read.format(kind).options(**options)
    if kind == "csv" and "header" not in options:
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    return reader.load(list(paths))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = True) -> DataFrame:
    """JSON lines, or files that each hold an array; those are read by one task each."""
    return read(spark, path, schema=schema, format="json", multiLine=not lines)


def discover(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of files, by Spark's own listing, so of any store."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def generations(spark: SparkSession, folder: str) -> dict[int, str]:
    """Number and path of each generation under a folder: subfolders gen-1, gen-2 and so on."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for s in fs.listStatus(root) if fs.exists(root) else []:
        p = s.getPath().toString()
        if m := _NUMBERED.search(p):
            out[int(m[1])] = p
    return dict(sorted(out.items()))


def sample(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
