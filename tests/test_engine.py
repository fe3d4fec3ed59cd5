import json
import random

import pytest
from pyspark.sql import functions as F

from lamina.engine import Engine, quick_query
from lamina.errors import QueryProblem, SchemaProblem, SyntaxProblem
from lamina.operators import reconcile as R
from lamina.operators.compaction import Generation, choose
from lamina.sources import sinks

NOW = 1_700_000_000_000_000


@pytest.fixture
def engine(spark):
    return Engine(spark, now=NOW)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def people(engine):
    engine.execute("CREATE TYPE address (street text, zip text)")
    engine.execute("CREATE TABLE people (city text, id int, name text, tags set<text>, notes list<text>, marks map<text, int>, home frozen<address>, motto text STATIC, PRIMARY KEY (city, id)) WITH CLUSTERING ORDER BY (id DESC)")
    engine.execute("INSERT INTO people (city, id, name, tags, notes, marks, home) VALUES ('a', 1, 'Ann', {'y', 'x'}, ['p'], {'k': 1}, {street: 's', zip: '9'}) USING TIMESTAMP 10")
    engine.execute("INSERT INTO people (city, id, name) VALUES ('a', 2, 'Bob'), ('b', 1, 'Cid') USING TIMESTAMP 10")
    return engine


def test_insert_and_read(people):
    r = people.execute("SELECT * FROM people WHERE city = 'a' AND id = 1").first()
    assert r.tags == ["x", "y"] and r.notes == ["p"] and r.marks == {"k": 1} and r.home.zip == "9"
    assert people.execute("SELECT home.street AS s FROM people WHERE name = 'Ann'").first().s == "s"


def test_update_collections(people):
    people.execute("UPDATE people USING TIMESTAMP 20 SET tags = tags + {'z'}, notes = ['o'] + notes, marks['n'] = 2 WHERE city = 'a' AND id = 1")
    people.execute("UPDATE people USING TIMESTAMP 30 SET tags -= {'x'}, notes += ['q'] WHERE city = 'a' AND id = 1")
    r = people.execute("SELECT tags, notes, marks FROM people WHERE city = 'a' AND id = 1").first()
    assert r.tags == ["y", "z"] and r.notes == ["o", "p", "q"] and r.marks == {"k": 1, "n": 2}


def test_last_write_wins_by_time_not_order(people):
    people.execute("UPDATE people USING TIMESTAMP 50 SET name = 'new' WHERE city = 'a' AND id = 1")
    people.execute("UPDATE people USING TIMESTAMP 40 SET name = 'old' WHERE city = 'a' AND id = 1")
    assert people.query_one("SELECT name FROM people WHERE city = 'a' AND id = 1")[0] == "new"


def test_deletes(people):
    people.execute("DELETE name FROM people USING TIMESTAMP 20 WHERE city = 'a' AND id = 1")
    assert people.query_one("SELECT name FROM people WHERE city = 'a' AND id = 1")[0] is None
    people.execute("DELETE FROM people USING TIMESTAMP 20 WHERE city = 'a' AND id = 1")
    people.execute("DELETE FROM people USING TIMESTAMP 5 WHERE city = 'b' AND id = 1")
    assert rows(people.execute("SELECT city, id FROM people")) == [("a", 2), ("b", 1)]
    people.execute("DELETE FROM people USING TIMESTAMP 60 WHERE city = 'a'")
    people.execute("INSERT INTO people (city, id) VALUES ('a', 7) USING TIMESTAMP 55")
    assert rows(people.execute("SELECT city, id FROM people")) == [("b", 1)]
    people.execute("INSERT INTO people (city, id) VALUES ('b', 5), ('b', 6) USING TIMESTAMP 60")
    people.execute("DELETE FROM people USING TIMESTAMP 70 WHERE city = 'b' AND id > 1 AND id < 6")
    assert rows(people.execute("SELECT id FROM people")) == [(1,), (6,)]


def test_ttl(spark):
    e = Engine(spark, now=NOW)
    e.execute("CREATE TABLE t (k int PRIMARY KEY, v text)")
    e.execute("INSERT INTO t (k, v) VALUES (1, 'x') USING TTL 10")
    assert e.query_count("SELECT * FROM t") == 1
    e.fixed_now = NOW + 11_000_000
    assert e.query_count("SELECT * FROM t") == 0


def test_conditions(people):
    assert people.execute("INSERT INTO people (city, id) VALUES ('a', 1) IF NOT EXISTS").first()[0] is False
    assert people.execute("UPDATE people SET name = 'x' WHERE city = 'a' AND id = 2 IF name = 'Nobody'").first()[0] is False
    assert people.execute("UPDATE people SET name = 'x' WHERE city = 'a' AND id = 2 IF name = 'Bob'").first()[0] is True
    assert people.execute("DELETE FROM people WHERE city = 'z' AND id = 2 IF EXISTS").first()[0] is False


def test_static(people):
    people.execute("UPDATE people SET motto = 'hi' WHERE city = 'a'")
    assert rows(people.execute("SELECT id, motto FROM people WHERE city = 'a'")) == [(1, "hi"), (2, "hi")]


def test_counter(engine):
    engine.execute("CREATE TABLE c (k int PRIMARY KEY, n counter)")
    for d in ("+ 5", "- 2", "+ 1"):
        engine.execute(f"UPDATE c SET n = n {d} WHERE k = 1")
    assert engine.query_one("SELECT n FROM c")[0] == 4


def test_batch_is_all_or_nothing(people):
    with pytest.raises(QueryProblem):
        people.execute("BEGIN BATCH INSERT INTO people (city, id) VALUES ('n', 1); INSERT INTO people (city, nope) VALUES ('n', 2); APPLY BATCH")
    assert people.query_count("SELECT * FROM people WHERE city = 'n'") == 0


def test_compaction_keeps_what_is_read(people):
    people.execute("UPDATE people USING TIMESTAMP 20 SET name = 'B' WHERE city = 'a' AND id = 2")
    people.execute("DELETE FROM people USING TIMESTAMP 20 WHERE city = 'b' AND id = 1")
    before = rows(people.execute("SELECT city, id, name FROM people"))
    people.compact("people")
    assert len(people.catalog.stored("people").generations) == 1
    assert rows(people.execute("SELECT city, id, name FROM people")) == before


def test_stored_on_disk(spark, tmp_path):
    from lamina.schema import table

    e = Engine(spark, now=NOW)
    e.create_table(table("main", "t", {"k": "int", "v": "text"}, ["k"]), str(tmp_path / "t"))
    e.execute("INSERT INTO t (k, v) VALUES (1, 'a')")
    e.execute("UPDATE t SET v = 'b' WHERE k = 1")
    assert rows(e.execute("SELECT k, v FROM t")) == [(1, "b")]
    from lamina.sources.readers import generations

    assert list(generations(spark, str(tmp_path / "t"))) == [1, 2]


def test_json_insert_and_select(people):
    people.execute("""INSERT INTO people JSON '{"city": "j", "id": 1, "name": "J", "notes": ["a"]}'""")
    assert json.loads(people.query_one("SELECT JSON id, notes, name FROM people WHERE city = 'j'")[0]) == {"id": 1, "notes": ["a"], "name": "J"}


def test_per_partition_and_order(people):
    people.execute("INSERT INTO people (city, id) VALUES ('a', 3)")
    assert rows(people.execute("SELECT city, id FROM people PER PARTITION LIMIT 1")) == [("a", 3), ("b", 1)]


def test_prepare(people):
    p = people.prepare("SELECT name FROM people WHERE city = ? AND id IN ?")
    assert rows(p.execute("a", [1, 2])) == [("Ann",), ("Bob",)]
    with pytest.raises(QueryProblem):
        p.execute("a")
    assert rows(people.prepare("SELECT id FROM people WHERE name = :n").execute(n="Cid")) == [(1,)]


def test_errors(people):
    for text, kind in [
        ("SELECT nope FROM people", QueryProblem),
        ("SELECT * FROM nowhere", QueryProblem),
        ("SELECT COUNT(SUM(id)) FROM people", QueryProblem),
        ("SELECT city, COUNT(*) FROM people GROUP BY id", QueryProblem),
        ("SELECT id FROM people WHERE COUNT(*) > 1", QueryProblem),
        ("SELECT id FROM people GROUP", SyntaxProblem),
        ("INSERT INTO people (id) VALUES (1)", QueryProblem),
        ("UPDATE people SET id = 3 WHERE city = 'a' AND id = 1", QueryProblem),
        ("CREATE TABLE bad (a nowhere PRIMARY KEY)", SchemaProblem),
        ("INSERT INTO people (city, id, notes) VALUES ('a', 1, [NULL])", QueryProblem),
        ("USE nowhere", QueryProblem),
    ]:
        with pytest.raises(kind):
            people.execute(text)
        assert people.validate(text)[0] is False or "INSERT" in text or "UPDATE" in text or "CREATE" in text or "USE" in text


def test_strict_filtering(spark):
    e = Engine(spark, now=NOW, strict=True)
    e.execute("CREATE TABLE t (a int, b int, c int, v int, PRIMARY KEY (a, b, c))")
    e.execute("SELECT * FROM t WHERE a = 1 AND b = 2")
    e.execute("SELECT * FROM t WHERE v = 1 ALLOW FILTERING")
    for w in ("v = 1", "b = 1", "a = 1 AND c = 1", "a = 1 AND v = 1"):
        with pytest.raises(QueryProblem):
            e.execute(f"SELECT * FROM t WHERE {w}")


def test_nulls(engine, spark):
    engine.register("t", spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "a int, b string"))
    assert engine.query_count("SELECT * FROM t WHERE b = NULL") == 0
    assert rows(engine.execute("SELECT COUNT(*) AS n, COUNT(b) AS k, SUM(a) AS s FROM t")) == [(3, 2, 3)]
    assert engine.query_count("SELECT * FROM t WHERE a NOT IN (SELECT a FROM t)") == 0
    assert engine.query_count("SELECT * FROM t WHERE 5 NOT IN (SELECT a FROM t WHERE a IS NOT NULL)") == 3


def test_alter_and_describe(people):
    people.execute("ALTER TABLE people ADD age int")
    people.execute("UPDATE people SET age = 5 WHERE city = 'a' AND id = 1")
    assert people.query_one("SELECT age FROM people WHERE city = 'a' AND id = 1")[0] == 5
    people.execute("ALTER TABLE people DROP notes")
    assert "notes" not in people.execute("SELECT * FROM people").columns
    assert people.execute("DESCRIBE people").filter("name = 'id'").first().role == "clustering desc"
    assert people.partition_keys("people") == ["city"] and people.column_type("people", "tags") == "set<text>"
    with pytest.raises(SchemaProblem):
        people.execute("ALTER TABLE people DROP city")


def test_exports(people, spark, tmp_path):
    from lamina.sources import sinks

    df = people.execute("SELECT city, id, name, tags, marks FROM people")
    assert sinks.export_all(df, str(tmp_path / "x"), ["csv", "json", "parquet", "orc", "nope"])["nope"] != "ok"
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == 3
    assert spark.read.json(str(tmp_path / "x.json")).count() == 3
    assert spark.read.csv(str(tmp_path / "x.csv"), header=True).count() == 3
    people.execute("CREATE TABLE again (city text, id int, name text, tags set<text>, marks map<text, int>, PRIMARY KEY (city, id))")
    people.import_file("again", str(tmp_path / "x.csv"), format="csv")
    assert rows(people.execute("SELECT city, id, name FROM again")) == rows(people.execute("SELECT city, id, name FROM people"))
    texts = [r[0] for r in sinks.insert_statements(df.filter("name = 'Ann'"), "again").collect()]
    assert texts == ["INSERT INTO again (city, id, name, tags, marks) VALUES ('a', 1, 'Ann', ['x', 'y'], {'k': 1});"]
    for style in ("table", "json", "csv", "yaml"):
        assert "Ann" in sinks.format_rows(df, style)
    sinks.to_json_array(df, str(tmp_path / "a.json"))
    assert len(json.load(open(tmp_path / "a.json"))) == 3
    assert quick_query(spark, str(tmp_path / "x.parquet"), "SELECT COUNT(*) AS n FROM data").first().n == 3


def test_excel_never_cuts(spark, tmp_path, monkeypatch):
    import pandas as pd

    wrote = []
    monkeypatch.setattr(pd.DataFrame, "to_excel", lambda self, path, index: wrote.append(len(self)))
    with pytest.raises(QueryProblem):
        sinks.to_excel(spark.range(4), str(tmp_path / "x.xlsx"), most_rows=3)
    sinks.to_excel(spark.range(3), str(tmp_path / "x.xlsx"), most_rows=3)
    assert wrote == [3]


def test_explain_and_stats(people):
    assert "Scan" in people.explain("SELECT name FROM people") or "Aggregate" in people.explain("SELECT name FROM people")
    assert people.execute("EXPLAIN SELECT name FROM people").count() > 3
    assert people.stats()["queries"] > 0
    assert people.query_exists("SELECT * FROM people") and [len(p) for p in people.pages("SELECT id FROM people", 2)] == [2, 1]


# ---------------------------------------------------------------- versions against a model


def model(versions, now):
    out = {}
    by = {}
    for v in versions:
        by.setdefault(v["k"], []).append(v)
    for k, vs in by.items():
        alive = lambda v: v["tombstone"] and (v["ttl"] is None or now <= v["deletion_time"] + v["ttl"])
        t = max((v["deletion_time"] for v in vs if alive(v)), default=None)
        rest = [v for v in vs if alive(v) and v["deletion_time"] == t or not v["tombstone"] and (t is None or v["write_time"] > t)]
        rest.sort(key=lambda v: (-v["generation"], -v["write_time"], v["seq"]))
        if rest and not rest[0]["tombstone"] and (rest[0]["ttl"] is None or now <= rest[0]["write_time"] + rest[0]["ttl"]):
            out[k] = rest[0]["seq"]
    return out


def random_versions(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        dead = rng.random() < 0.3
        at = rng.randrange(20)
        out.append({"k": rng.randrange(60), "seq": i, "generation": rng.randrange(4), "write_time": at, "ttl": rng.choice([None, None, rng.randrange(15)]), "tombstone": dead, "deletion_time": at if dead else None})
    return out


SCHEMA = "k int, seq int, generation int, write_time long, ttl long, tombstone boolean, deletion_time long"


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_generations_against_model(spark, seed):
    v = random_versions(500, seed)
    got = R.merge_generations(spark.createDataFrame(v, SCHEMA), ["k"], 18, ["seq"])
    assert {r.k: r.seq for r in got.collect()} == model(v, 18)


def test_merge_has_one_exchange(spark):
    df = R.merge_generations(spark.createDataFrame(random_versions(10, 3), SCHEMA), ["k"], 18)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_range_tombstones(spark):
    r = spark.createDataFrame([(1, c, w) for c in range(6) for w in (5, 15)], "p int, c int, write_time long")
    t = spark.createDataFrame([(1, 2, 4, 10, None), (1, None, None, 99, None), (1, 5, None, 10, 3)], "p int, range_start int, range_end int, deletion_time long, ttl long")
    for limit in (100, 0):
        got = rows(R.apply_range_tombstones(r, t, ["p"], "c", 14, limit))
        assert got == sorted((1, c, w) for c in range(6) for w in (5, 15) if not (2 <= c <= 4 and w < 10))


def test_choose():
    g = [Generation(i, 4 << 20) for i in range(1, 7)]
    assert [x.number for x in choose(g)] == [1, 2] and choose(g[:4]) == []
    assert len(choose(g, "leveled")) == 6 and choose(g[:2], "leveled") == [] and choose(g, "time_window") == []
    with pytest.raises(ValueError):
        choose(g, "other")


def test_streaming_upsert(spark, tmp_path):
    from lamina.streaming import tail

    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = spark.createDataFrame([], SCHEMA).schema
    v = random_versions(200, 5)
    for part in (v[:100], v[100:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = tail.upsert(tail.read_generations(spark, src, schema), ["k"], state, str(tmp_path / "checkpoint"), now=18)
        assert q.awaitTermination(60)
    assert tail.latest(spark, state).count() == tail.latest(spark, state).select("k").distinct().count() > 0


def test_streaming_windows(spark, tmp_path):
    from lamina.streaming import tail

    src = str(tmp_path / "ev")
    spark.range(100).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") % 2).alias("u")).coalesce(1).write.parquet(src)
    stream = tail.read_generations(spark, src, spark.read.parquet(src).schema)
    q = tail.windowed(stream, "ts", "10 minutes", ["u"]).writeStream.format("memory").queryName("wins").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.n for r in spark.sql("SELECT * FROM wins").collect()} <= {10}


def test_cli(spark, tmp_path, capsys):
    from lamina import cli

    path = str(tmp_path / "d.parquet")
    spark.range(5).withColumn("g", F.col("id") % 2).write.parquet(path)
    assert cli.main(["query", "-t", f"d={path}", "SELECT g, COUNT(*) AS n FROM d GROUP BY g ORDER BY g", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"g": 0, "n": 3}, {"g": 1, "n": 2}]
    assert cli.main(["query", "-t", f"d={path}", "SELECT nope FROM d"]) == 1


def test_what_a_stream_gives_lies_in_files(spark, tmp_path, sf_dir):
    from lamina import catalogue
    from lamina.streaming import tail

    assert catalogue.queries()["streamed_sessions"](spark, sf_dir).inputFiles()  # a table in memory would hold all rows in the driver
    src, state = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.range(4).selectExpr(f"id + {4 * k} AS id", "timestamp_seconds(id) AS ts").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: tail.read_generations(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    assert sorted(r.id for r in tail.arrived(stream(), "append", f"{state}/a", f"{state}/ca").collect()) == list(range(12))
    got = tail.arrived(tail.windowed(stream(), "ts", "1 hour"), "complete", f"{state}/c", f"{state}/cc")
    assert [r.n for r in got.collect()] == [12] and len(tail._folders(spark, f"{state}/c")) == 1


def test_rows_that_outlive_lie_in_files(spark, sf_dir):
    from lamina import catalogue

    assert catalogue.queries()["streamed_ttl"](spark, sf_dir).inputFiles()


def test_rows_that_outlive_do_not_pass_through_the_driver(spark, tmp_path):
    from lamina import catalogue

    spark.range(100_000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    conf = spark.sparkContext._jsc.sc().conf()  # Spark looks at it again for each stage
    was = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")  # a table in memory got 1,377 KiB from each of four tasks
    try:
        got = catalogue.queries()["streamed_ttl"](spark, str(tmp_path)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids")).collect()
    finally:
        conf.set("spark.driver.maxResultSize", was)
    assert [tuple(r) for r in got] == [("long", 100_000, 100_000)]
