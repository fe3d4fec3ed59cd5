import os

import pytest

from lamina.llm import decontaminate as D

duckdb = pytest.importorskip("duckdb")


def pairs(df):
    return sorted((r.doc_id, r.item_id) for r in df.collect())


def test_against_sql(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(d, t)}.parquet'")
    want = sorted(c.sql(D.oracle()).fetchall())
    for limit in (D.BROADCAST_WORDS, 0):
        got = D.contaminated(docs, bench, limit)
        assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "score", "n_match", "item_words").collect()) == want
    assert D.decontaminate(docs, bench).count() == docs.count() - len({w[0] for w in want})


def test_substitutions(spark):
    item = [f"word{i}" for i in range(30)]
    changed = [w if i % 6 else "other" for i, w in enumerate(item)]
    far = [w if i % 2 else "other" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "pre " + " ".join(item) + " post"), (2, "so, " + " ".join(changed).upper()), (3, " ".join(far)), (4, " ".join(item[:14])), (5, " ".join(item[:9])), (6, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert pairs(D.contaminated(docs, bench)) == [(1, 1), (2, 1), (4, 1)]


def test_spread_substitutions_in_short_items(spark):
    """One to three words changed inside items of 8 to 21 words, as far as four fifths of them stay."""
    rows, want = [], []
    for n in (8, 12, 15, 16, 18, 20, 21):
        item = [f"i{n}w{k}" for k in range(n)]
        for changed in range(1, 4):
            at = [round((j + 1) * n / (changed + 1)) for j in range(changed)]
            text = " ".join(w if k not in at else "other" for k, w in enumerate(item))
            rows.append((n * 10 + changed, text))
            if (n - changed) * 10 >= n * 8 and n >= 12:
                want.append((n * 10 + changed, n))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (8, 12, 15, 16, 18, 20, 21)], "item_id long, text string")
    assert set(want) <= set(pairs(D.contaminated(docs, bench)))


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one two three four five seven"), (3, "yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "One two; three four five six"), (2, "yes"), (3, None), (4, "")], "item_id long, text string")
    assert pairs(D.contaminated(docs, bench)) == [(1, 1)]


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and looked at the other cat"), (2, None)], "item_id long, text string")
    assert pairs(D.contaminated(odd, bench)) == [(1, 1)]
    kept = D.decontaminate(odd, bench)
    assert kept.count() == 11 and kept.columns == odd.columns
    assert D.decontaminate(odd, bench.limit(0)).count() == 12 and D.contaminated(odd.limit(0), bench).count() == 0


def test_no_python(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = D.contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
