from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, and columns whose names operators use themselves."""
    long = "lorem ipsum dolor sit amet " * 3000
    rows = [
        (1, "the cat sat on the mat and looked at the other cat for a long while today", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \n\t ", "de", None),
        (None, "a text without an id that goes on for quite a few words so that it counts", "en", "a"),
        (5, long, "en", "b"),
        (6, long + "end", "en", "b"),
        (7, "ein kurzer Text", "de", "b"),
        (7, "ein kurzer Text", "de", "b"),
        (8, "1234 5678", None, None),
        (9, "!!!", "fr", "c"),
        (10, "naïve café ☕ 漢字 \U0001f600", "fr", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("score", "shard", "node", "label", "found", "size", "weight", "topic", "lang_pred", "n", "crc", "hits", "quality_score", "item_id", "k1", "n_tokens")}
    return df.withColumns(extra)
