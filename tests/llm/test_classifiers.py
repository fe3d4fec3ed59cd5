import zlib

import pandas as pd
import pytest

from lamina.llm import zstd_classifiers as Z


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_shape_marks_repeats():
    assert Z.shape(b"Abc abc 12, Abc") == b"Aa a 0, Aa"
    assert Z.shape(b"word word word end").count(b"\x01") == 2
    assert b"\x02" in Z.shape(b"A whole line here.\nA whole line here.\n" * 2)
    assert Z.shape(b"") == b""


def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Z.identify(docs, Z.fit_language(docs)).toPandas()
    out = got[[held(i) for i in got.doc_id]]
    assert (out.lang_pred == out.lang).mean() > 0.97
    assert got.lang_score.between(0, 1).all() and len(got) == docs.count()
    assert got.lang_rejected.mean() < 0.02


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Z.rate(docs, Z.fit_quality(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    out = got[[held(i) for i in got.doc_id]]
    assert (out.quality_pred == out.quality).mean() > 0.9
    assert got.quality_score.between(0, 1).all()


def test_equal_texts_equal_scores(spark, docs):
    got = Z.identify(docs, Z.fit_language(docs)).toPandas()
    assert got.groupby("text").lang_score.nunique().max() == 1


def test_odd_rows(spark, odd):
    model = Z.fit_language(odd)
    got = Z.identify(odd, model).toPandas()
    assert len(got) == 12 and (got.lang_pred[got.text.isin([None, "", "!!!", "1234 5678"]) | got.text.isna()] == "und").all()
    assert got.lang_rejected[got.lang_pred == "und"].all()
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, 0), (7, 0, 0), (None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    rated = Z.rate(odd, Z.fit_quality(odd, labels)).toPandas()
    assert len(rated) == 12 and rated.quality_score.between(0, 1).all()
    for empty in (odd.limit(0),):
        assert Z.identify(empty, Z.fit_language(empty)).count() == 0
        assert Z.identify(odd, Z.fit_language(empty)).filter("lang_pred <> 'und'").count() == 0
    assert Z.rate(odd, Z.fit_quality(odd, labels.limit(0))).filter("quality_score = 0.5").count() == 12


@pytest.mark.parametrize("y,want", [([1, 1], 1.0), ([0, 0], 0.0), ([], 0.5)])
def test_one_class(y, want):
    assert Z.QualityModel(pd.DataFrame({"y": y, "t": ["text"] * len(y)})).score("anything") == want
