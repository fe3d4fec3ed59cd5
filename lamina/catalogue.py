"""Registered queries of the engine, each with the SQL for DuckDB that it is checked against.

Most are one statement of the dialect; where the SQL is the same it is given once. Operators that are functions on DataFrames
are called as such.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.dialect.nodes import Table, walk
from lamina.dialect.parser import parse
from lamina.engine import Engine
from lamina.operators import collections as C
from lamina.operators import compaction as K
from lamina.operators import partitions as P
from lamina.operators import reconcile as R
from lamina.schema import table
from lamina.sources import readers, sinks, stats
from lamina.streaming import tail

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "embeddings")
KEYS = {"events": (["user_id"], [("ts", "DESC"), "event_id"]), "orders": (["o_custkey"], [("o_orderdate", "DESC"), "o_orderkey"]), "conversations": (["conv_id"], ["turn"]), "customer": (["c_custkey"], [])}
#: The time at which versions are merged, in microseconds: a fixed one, so that results are.
NOW = 1_704_067_200_000_000


def engine(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> Engine:
    """An engine over tables of a folder: each costs a look at its files. Times of Parquet come without a zone; they are UTC."""
    out = Engine(spark, now=NOW)
    for t in tables:
        out.register(t, read(spark, sf_dir, t), *KEYS.get(t, (None, [])))
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SAME: dict[str, str] = {
    "flagship": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, ROUND(AVG(l_discount), 6) AS a FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10 ORDER BY l_returnflag, l_linestatus LIMIT 10",
    # projection
    "select_star": "SELECT * FROM nation",
    "select_cols": "SELECT o_orderkey, o_totalprice FROM orders",
    "select_qualified": "SELECT c.c_custkey, c.c_name FROM customer c",
    "select_alias_literal": "SELECT n_name AS name, 1 AS one, 'x' AS word, TRUE AS yes FROM nation",
    "select_star_expr": "SELECT r.*, r_regionkey + 1 AS next FROM region r",
    "select_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders",
    "case_operand": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders",
    # filters
    "filter_eq": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "filter_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "filter_cmp": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05 AND l_tax <= 0.04",
    "filter_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
    "filter_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 7",
    "filter_not_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 48",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_t%'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%E%'",
    "filter_like_dot": "SELECT c_custkey FROM customer WHERE c_name LIKE 'C.%'",
    "filter_prefix": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'",
    "filter_bool_tree": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 150000) AND NOT (o_orderpriority = '5-LOW' AND o_totalprice < 50000)",
    "filter_null": "SELECT event_id FROM (SELECT event_id, NULLIF(event_type, 'click') AS kind FROM events) e WHERE kind IS NULL",
    "filter_not_null": "SELECT event_id, kind FROM (SELECT event_id, NULLIF(event_type, 'click') AS kind FROM events) e WHERE kind IS NOT NULL AND kind <> 'error'",
    "filter_null_compare": "SELECT event_id FROM (SELECT event_id, NULLIF(event_type, 'click') AS kind FROM events) e WHERE NOT (kind = 'view')",
    "filter_timestamp": "SELECT event_id FROM events WHERE ts >= '2024-01-10 00:00:00' AND ts < '2024-01-12 12:00:00'",
    # aggregation
    "agg_global": "SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last FROM lineitem",
    "agg_empty": "SELECT COUNT(*) AS n, COUNT(l_quantity) AS k, MAX(l_quantity) AS m FROM lineitem WHERE l_quantity < 0",
    "agg_group": "SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total, ROUND(AVG(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus",
    "agg_multi": "SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber",
    "agg_count_column": "SELECT COUNT(*) AS n, COUNT(kind) AS k FROM (SELECT NULLIF(event_type, 'click') AS kind FROM events) e",
    "agg_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "agg_distinct_sum": "SELECT SUM(DISTINCT l_linenumber) AS s, MIN(DISTINCT l_linenumber) AS a, MAX(DISTINCT l_linenumber) AS b, ROUND(AVG(DISTINCT l_linenumber), 6) AS m FROM lineitem",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12 AND SUM(o_totalprice) > 100000",
    "agg_expr_key": "SELECT l_linenumber % 3 AS r, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber % 3",
    "agg_alias_key": "SELECT o_totalprice > 100000 AS big, COUNT(*) AS n FROM orders GROUP BY big",
    "agg_expression": "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)) / COUNT(*), 3) AS mean FROM lineitem GROUP BY l_returnflag",
    "agg_stddev": "SELECT l_returnflag, ROUND(STDDEV(l_quantity), 6) AS s, ROUND(VARIANCE(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag",
    # order and limits
    "order_multi": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice ASC, o_orderkey LIMIT 50",
    "order_expression": "SELECT o_orderkey FROM orders ORDER BY o_totalprice * -1, o_orderkey LIMIT 20",
    "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25",
    "offset_only": "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25",
    "order_aggregate": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10",
    # windows
    "row_number_window": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events",
    "rank_window": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part",
    "running_window": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events",
    "lag_window": "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations",
    # arithmetic and casts
    "arith_mod": "SELECT o_orderkey, o_orderkey % 7 AS m, -(o_orderkey % 5) AS u, (3 - o_orderkey) % 4 AS w FROM orders",
    "arith_float": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge FROM lineitem",
    "cast": "SELECT o_orderkey, CAST(o_orderkey AS double) AS d, CAST(o_orderstatus AS varchar) AS s, CAST(o_orderkey % 100 AS smallint) AS i FROM orders",
    "null_handling": "SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'none') AS kind FROM events",
    "math_functions": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(abs(l_discount - 0.05), 6) AS a, ROUND(exp(l_discount), 6) AS e, ROUND(ln(l_quantity), 6) AS l, ROUND(log10(l_quantity), 6) AS t FROM lineitem",
    "string_functions": "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, substring(c_name, 1, 4) AS s, c_name || '!' AS x FROM customer",
    # joins and subqueries
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_three": "SELECT n.n_name, COUNT(*) AS orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_using": "SELECT event_type, COUNT(*) AS n FROM events e JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') x USING (user_id) GROUP BY event_type",
    "semi_join": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "exists_query": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "not_exists_query": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "scalar_subquery_item": "SELECT r_regionkey, (SELECT COUNT(*) FROM nation) AS nations FROM region",
    "derived_table": "SELECT band, COUNT(*) AS n FROM (SELECT o_orderkey, o_totalprice > 100000 AS band FROM orders) x GROUP BY band",
    "cte": "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), rich AS (SELECT o_custkey FROM big WHERE total > 500000) SELECT COUNT(*) AS n FROM rich",
    # vectors
    "select_vectors": "SELECT label, COUNT(*) AS n FROM embeddings GROUP BY label",
}

#: Statements whose SQL differs: dialect, then DuckDB.
_PAIRS: dict[str, tuple[str, str]] = {
    "filter_composite": (
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) >= (100, 3) AND (l_orderkey, l_linenumber) < (300, 2)",
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey > 100 OR l_orderkey = 100 AND l_linenumber >= 3) AND (l_orderkey < 300 OR l_orderkey = 300 AND l_linenumber < 2)",
    ),
    "filter_regex": ("SELECT p_partkey FROM part WHERE p_name REGEXP '[aeiou]{2}'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')"),
    "filter_allow_filtering": ("SELECT event_id FROM events WHERE event_type = 'click' ALLOW FILTERING", "SELECT event_id FROM events WHERE event_type = 'click'"),
    "filter_eq_params": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000"),
    "filter_named_params": ("SELECT o_orderkey FROM orders WHERE o_orderstatus IN :states", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')"),
    "order_nulls": ("SELECT event_id, NULLIF(event_type, 'click') AS kind FROM events ORDER BY kind, event_id LIMIT 40", "SELECT event_id, NULLIF(event_type, 'click') AS kind FROM events ORDER BY kind ASC NULLS FIRST, event_id LIMIT 40"),
    "order_nulls_desc": ("SELECT event_id, NULLIF(event_type, 'view') AS kind FROM events ORDER BY kind DESC, event_id LIMIT 40", "SELECT event_id, NULLIF(event_type, 'view') AS kind FROM events ORDER BY kind DESC NULLS LAST, event_id LIMIT 40"),
    "per_partition_limit": ("SELECT user_id, event_id, ts FROM events PER PARTITION LIMIT 3", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3"),
    "per_partition_filtered": ("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' PER PARTITION LIMIT 1", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r <= 1"),
    "arith_int": ("SELECT o_orderkey, o_orderkey / 7 AS q, (3 - o_orderkey) / 4 AS t FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, (3 - o_orderkey) // 4 AS t FROM orders"),
    "divide_by_zero": ("SELECT l_orderkey, l_linenumber, l_partkey, ROUND(l_quantity / (l_discount * 0), 2) AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, NULL::DOUBLE AS q FROM lineitem"),
    "date_group": ("SELECT DATE(ts) AS day, COUNT(*) AS n FROM events GROUP BY day", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY day"),
    "interval_filter": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderdate > NOW() - INTERVAL 9000 DAYS", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '2024-01-01 00:00:00' - INTERVAL 9000 DAYS"),
    "list_index": ("SELECT o_orderkey, l[0] AS a, l[2] AS b, l[5] AS c FROM (SELECT o_orderkey, [o_orderstatus, o_orderpriority, 'x'] AS l FROM orders) t", "SELECT o_orderkey, o_orderstatus AS a, 'x' AS b, NULL::VARCHAR AS c FROM orders"),
    "map_get": ("SELECT o_orderkey, m['s'] AS s, m['none'] AS n FROM (SELECT o_orderkey, {'s': o_orderstatus, 'p': o_orderpriority} AS m FROM orders) t", "SELECT o_orderkey, o_orderstatus AS s, NULL::VARCHAR AS n FROM orders"),
    "contains": ("SELECT o_orderkey FROM (SELECT o_orderkey, {o_orderstatus, o_orderpriority} AS s FROM orders) t WHERE s CONTAINS 'F'", "SELECT o_orderkey FROM orders WHERE list_contains([o_orderstatus, o_orderpriority], 'F')"),
    "contains_map_value": ("SELECT o_orderkey FROM (SELECT o_orderkey, {'s': o_orderstatus} AS m FROM orders) t WHERE m CONTAINS 'O'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"),
    "contains_key": ("SELECT o_orderkey FROM (SELECT o_orderkey, {o_orderstatus: 1} AS m FROM orders) t WHERE m CONTAINS KEY 'P'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "collection_aggs": ("SELECT vec_id, collection_count(embedding) AS n, ROUND(collection_min(embedding), 5) AS a, ROUND(collection_max(embedding), 5) AS b, ROUND(collection_sum(embedding), 4) AS s, ROUND(collection_avg(embedding), 5) AS m FROM embeddings", "SELECT vec_id, len(embedding)::INT AS n, ROUND(list_min(embedding), 5) AS a, ROUND(list_max(embedding), 5) AS b, ROUND(list_sum(embedding::DOUBLE[]), 4) AS s, ROUND(list_avg(embedding::DOUBLE[]), 5) AS m FROM embeddings"),
    "tuple_field": ("SELECT n_nationkey, t[1] AS b FROM (SELECT n_nationkey, (n_regionkey, n_name) AS t FROM nation) x", "SELECT n_nationkey, n_name AS b FROM nation"),
    "udt_field": ("SELECT n_nationkey, place.label AS l FROM (SELECT n_nationkey, named_struct('label', n_name, 'region', n_regionkey) AS place FROM nation) x WHERE place.region > 1", "SELECT n_nationkey, n_name AS l FROM nation WHERE n_regionkey > 1"),
    "json_extract": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "vector_cosine": ("SELECT a.vec_id, ROUND(cosine_similarity(a.embedding, b.embedding), 5) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = 0", "SELECT a.vec_id, ROUND(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = 0"),
    "vector_euclid": ("SELECT a.vec_id, ROUND(euclidean_distance(a.embedding, b.embedding), 5) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = 0", "SELECT a.vec_id, ROUND(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = 0"),
    "select_json": ("SELECT JSON n_nationkey, n_name FROM nation", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS "[json]" FROM nation"""),
    "select_json_distinct": ("SELECT JSON DISTINCT n_regionkey FROM nation", """SELECT DISTINCT '{"n_regionkey":' || n_regionkey || '}' AS "[json]" FROM nation"""),
    "mask": ("SELECT c_custkey, mask_inner(c_name, 2, 3) AS m, mask_default(c_mktsegment) AS d FROM customer", "SELECT c_custkey, c_name[1:2] || repeat('*', length(c_name) - 5) || right(c_name, 3) AS m, regexp_replace(regexp_replace(regexp_replace(c_mktsegment, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS d FROM customer"),
    "blob_text": ("SELECT n_nationkey, blobastext(textasblob(n_name)) AS t FROM nation", "SELECT n_nationkey, n_name AS t FROM nation"),
    "timeuuid_date": ("SELECT n_nationkey, tounixtimestamp(dateof('13814000-1dd2-11b2-8080-808080808080')) AS t FROM nation", "SELECT n_nationkey, 0::BIGINT AS t FROM nation"),
    "system_tables": ("SELECT table_name FROM system.tables", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'conversations', 'embeddings']) AS table_name"),
}

_PARAMS = {"filter_eq_params": ["O", 100000], "filter_named_params": {"states": ["O", "P"]}}


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: of a user's events of one type in three generations; errors are tombstones, some values expire."""
    e = read(spark, sf_dir, "events")
    wt = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        (F.col("user_id") * 10 + F.col("event_id") % 7).alias("k"),
        "user_id",
        "event_id",
        (F.col("event_id") % 3).cast("int").alias("generation"),
        wt.alias("write_time"),
        F.when(F.col("event_id") % 5 == 0, F.lit(864_000_000_000) * 10).alias("ttl"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.when(F.col("event_type") == "error", wt).alias("deletion_time"),
        F.col("value"),
    )


_VERSIONS = """v AS (SELECT user_id * 10 + event_id % 7 AS k, user_id, event_id, (event_id % 3)::INT AS generation, epoch_us(ts) AS write_time, CASE WHEN event_id % 5 = 0 THEN 8640000000000 END AS ttl,
 event_type = 'error' AS tombstone, CASE WHEN event_type = 'error' THEN epoch_us(ts) END AS deletion_time, value FROM events)"""
_MERGED = """a AS (SELECT *, tombstone AND (ttl IS NULL OR {now} <= deletion_time + ttl) AS act FROM {source}), b AS (SELECT *, MAX(CASE WHEN act THEN deletion_time END) OVER (PARTITION BY {key}) AS t FROM a),
 c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY generation DESC, write_time DESC, event_id) AS rn FROM b WHERE (act AND deletion_time = t) OR (NOT tombstone AND (t IS NULL OR write_time > t)))"""
_ALIVE = "(ttl IS NULL OR {now} <= write_time + ttl)"
_AT = "CASE WHEN tombstone THEN deletion_time ELSE write_time END"


def merge_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir).filter(~F.col("tombstone")).withColumn("ttl", F.lit(None).cast("long"))
    return R.merge_generations(v, ["k"], NOW, ["event_id"]).select("k", "event_id", "value")


def merge_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_generations(versions(spark, sf_dir), ["k"], NOW, ["event_id"]).select("k", "event_id", "value")


def merge_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drop_expired(versions(spark, sf_dir).filter(~F.col("tombstone")), NOW).select("event_id", "value")


def merge_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_conflicts(versions(spark, sf_dir), ["k"], NOW).select("k", "write_time")


def gc_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collectable_tombstones(versions(spark, sf_dir), NOW, 864_000).select("event_id")


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    parts = {g: v.filter(F.col("generation") == g).drop("generation") for g in range(3)}
    return K.compact(K.union_generations(parts), ["k"], NOW).select("k", "tombstone", F.coalesce("deletion_time", "write_time").alias("at"))


def _as_cells(v: DataFrame) -> DataFrame:
    return v.withColumn("column", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")).withColumn("row_tombstone", F.col("tombstone") & (F.col("event_id") % 4 == 0))


def merge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _as_cells(versions(spark, sf_dir))
    merged = R.merge_rows(cells, ["user_id"], NOW, tiebreak=["event_id"])
    return R.pivot_cells(merged, ["user_id"], ["even", "odd"], value="event_id")


def merge_range_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    rows = v.filter(~F.col("tombstone")).select("user_id", "event_id", "write_time")
    t = v.filter("tombstone").select("user_id", F.when(F.col("event_id") % 4 > 0, F.col("event_id") - 500).alias("range_start"), F.when(F.col("event_id") % 4 < 3, F.col("event_id") + 500).alias("range_end"), "deletion_time", "ttl")
    return R.apply_range_tombstones(rows, t, ["user_id"], "event_id", NOW)


def merge_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir).withColumns({"tags": F.array(F.col("event_id") % 4, F.col("event_id") % 6, F.lit(9).cast("long")), "gone": F.array(F.col("event_id") % 2)})
    return R.merge_collections(v, ["k"], NOW, "tags", "gone").select("k", "event_id", F.size("tags").alias("n"), F.array_min("tags").alias("least"))


def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_counters(versions(spark, sf_dir).withColumn("delta", F.col("event_id") % 5 - 2), ["user_id"], "delta")


def collection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("l"))
    x = F.array(F.lit("F"), F.lit("z"))
    return o.select("o_orderkey", F.array_join(C.append(F.col("l"), x), ",").alias("appended"), F.array_join(C.prepend(F.col("l"), x), ",").alias("prepended"), F.array_join(C.remove(F.col("l"), x), ",").alias("removed"), F.array_join(C.set_add(F.col("l"), x), ",").alias("added"))


def partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, spec = engine(spark, sf_dir, ("events",)).catalog.find("events", NOW)
    return P.partition_scan(df, spec, {"user_id": 7}).select("event_id", "ts")


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, spec = engine(spark, sf_dir, ("conversations",)).catalog.find("conversations", NOW)
    return P.point_get(df, spec, {"conv_id": 3, "turn": 1}).select("conv_id", "turn", "role")


def clustering_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, spec = engine(spark, sf_dir, ("orders",)).catalog.find("orders", NOW)
    # o_orderdate descends, so the low end is the later date
    low, high = "1998-01-01 00:00:00", "1994-01-01 00:00:00"
    return P.clustering_range(df, spec, {"o_custkey": 7}, (low,), (high,)).select("o_orderkey", "o_orderdate")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest_per_key(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id")


def static_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("mark"))
    spec = table("main", "talks", {"conv_id": "bigint", "turn": "bigint", "mark": "bigint"}, ["conv_id"], ["turn"], ["mark"])
    return P.spread_statics(df, spec)


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_stats(read(spark, sf_dir, "events"), ["user_id"])


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), exact=True)


def multi_generation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return K.union_generations({1: e.filter("event_id % 2 = 0"), 2: e.filter("event_id % 2 = 1").drop("value")})


def multi_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_all([read(spark, sf_dir, t) for t in ("orders", "customer", "part")])


def token_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranges that cover the ring give each row once."""
    df, spec = engine(spark, sf_dir, ("events",)).catalog.find("events", NOW)
    third = (1 << 64) // 3
    edges = [-(1 << 63), -(1 << 63) + third, -(1 << 63) + 2 * third, (1 << 63) - 1]
    parts = [P.token_range(df, spec, a, b) for a, b in zip(edges, edges[1:], strict=False)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("event_id")


def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table through its life: load, update, delete, compact."""
    e = Engine(spark, now=NOW)
    e.execute("CREATE TABLE people (region int, id bigint, name text, score double, PRIMARY KEY (region, id))")
    n = read(spark, sf_dir, "nation")
    e.insert_frame("people", n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(1.0).alias("score")), write_time=10)
    e.execute("UPDATE people USING TIMESTAMP 20 SET score = 2.5 WHERE region = 1 AND id = 1")
    e.execute("DELETE FROM people USING TIMESTAMP 30 WHERE region = 2")
    e.execute("INSERT INTO people (region, id, name) VALUES (2, 900, 'new') USING TIMESTAMP 40")
    return e.execute("SELECT region, id, name, score FROM people")


def _folder(spark: SparkSession) -> str:
    """A new folder where executors and driver can both write."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lamina-catalogue-{uuid.uuid4().hex}"


def _orders_table(spark: SparkSession, sf_dir: str, path: str | None) -> Engine:
    """Orders as a stored table, by customer and order."""
    e = Engine(spark, now=NOW)
    e.create_table(table("main", "kept", {"cust": "bigint", "id": "bigint", "state": "text", "price": "double"}, ["cust"], ["id"]), path)
    o = read(spark, sf_dir, "orders")
    e.insert_frame("kept", o.select(F.col("o_custkey").cast("long").alias("cust"), F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").cast("double").alias("price")), write_time=10)
    return e


def stored_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions write to one folder, a third one reads: nothing is lost."""
    path = _folder(spark)
    _orders_table(spark, sf_dir, path)
    two = Engine(spark, now=NOW).open_table(path)
    two.execute("INSERT INTO kept (cust, id, state) VALUES (-1, -1, 'new') USING TIMESTAMP 20")
    return Engine(spark, now=NOW).open_table(path).execute("SELECT cust, id, state, price FROM kept")


def stored_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest writes that have expired, and writes of equal times, read alike after compaction: old values don't come back."""
    e = _orders_table(spark, sf_dir, _folder(spark))
    o = e.execute("SELECT cust, id FROM kept")
    e.insert_frame("kept", o.filter("id % 3 = 0").withColumn("state", F.lit("gone")), write_time=20, ttl_seconds=1)
    e.insert_frame("kept", o.filter("id % 3 = 1").withColumn("state", F.lit("later")), write_time=10)
    e.fixed_now = NOW + 5_000_000
    e.compact("kept")
    e.compact("kept")
    return e.execute("SELECT cust, id, state, price FROM kept")


def stored_range_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete by clustering range also hides older writes that arrive after it, and after compaction."""
    e = _orders_table(spark, sf_dir, _folder(spark))
    e.execute("DELETE FROM kept USING TIMESTAMP 1704067199000000 WHERE cust = 7 AND id > 0 AND id <= 100000")
    e.execute("INSERT INTO kept (cust, id, state) VALUES (7, 50, 'old') USING TIMESTAMP 15")
    e.execute("INSERT INTO kept (cust, id, state) VALUES (7, 51, 'new') USING TIMESTAMP 1704067199500000")
    e.compact("kept")
    e.execute("INSERT INTO kept (cust, id, state) VALUES (7, 52, 'old') USING TIMESTAMP 16")
    return e.execute("SELECT cust, id, state, price FROM kept")


def stored_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of all rows of a partition, by values that rows hold, and of the table's columns."""
    e = _orders_table(spark, sf_dir, None)
    e.execute("UPDATE kept USING TIMESTAMP 20 SET price = price * 2 WHERE cust = 7 AND id > 0")
    e.execute("DELETE FROM kept USING TIMESTAMP 30 WHERE cust = 8 AND id > 0 IF state = 'F'")
    e.execute("ALTER TABLE kept ADD note text")
    e.execute("ALTER TABLE kept DROP note")
    return e.execute("SELECT cust, id, state, price FROM kept")


def _round_trip(format: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
        path = f"{_folder(spark)}.{format}"
        sinks.export(df, path, format)
        return readers.read(spark, path, schema=df.schema, format=format)

    return run


def insert_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.to_sql(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, "nation")
    return spark.read.text(path)


def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file into a stored table, with the table's types."""
    path = f"{_folder(spark)}.csv"
    sinks.export(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path, "csv")
    e = Engine(spark, now=NOW)
    e.execute("CREATE TABLE lands (id bigint PRIMARY KEY, name text)")
    e.import_file("lands", path)
    return e.execute("SELECT id, name FROM lands")


def insert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, now=NOW)
    e.execute("CREATE TABLE j (id int PRIMARY KEY, name text, tags set<text>)")
    e.execute("""INSERT INTO j JSON '{"id": 1, "name": "a", "tags": ["x"]}'""")
    e.execute("BEGIN BATCH INSERT INTO j (id, name) VALUES (2, 'b'); UPDATE j SET name = 'c' WHERE id = 1; APPLY BATCH")
    e.execute("INSERT INTO j (id, name) VALUES (2, 'z') IF NOT EXISTS")
    return e.execute("SELECT id, name FROM j")


def merge_map_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir).withColumns({"tags": F.create_map(F.lit("a"), F.col("event_id"), F.lit("b"), F.col("event_id") + 1), "gone": F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))})
    return R.merge_collections(v, ["k"], NOW, "tags", "gone", is_map=True).select("k", "event_id", F.size("tags").alias("n"), F.array_min(F.map_values("tags")).alias("least"))


def streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as a stream in two arrivals, merged into the latest state."""
    folder, v = _folder(spark), versions(spark, sf_dir).drop("generation")
    for k in range(2):
        v.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{folder}/in")
        tail.upsert(tail.read_generations(spark, f"{folder}/in", v.schema), ["k"], f"{folder}/state", f"{folder}/checkpoint", now=NOW).awaitTermination()
    return tail.latest(spark, f"{folder}/state").select("k", "write_time")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over events as a stream."""
    folder, e = _folder(spark), read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(f"{folder}/in")
    out = tail.windowed(tail.read_generations(spark, f"{folder}/in", e.schema), "ts", "1 day", ["event_type"], late="3650 days")
    name = f"w{uuid.uuid4().hex}"
    out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prepared statement, bound twice."""
    p = engine(spark, sf_dir, ("orders",)).prepare("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = ? AND o_custkey IN ?")
    return p.execute("F", [7, 8, 10]).unionByName(p.execute("O", [7]))


def table_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made, changed, emptied and dropped: what is left, by table."""
    e = Engine(spark, now=NOW)
    for t in ("stays", "emptied", "dropped"):
        e.execute(f"CREATE TABLE {t} (id int PRIMARY KEY, name text, spare text)")
        e.insert_frame(t, read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name")), write_time=10)
    e.execute("ALTER TABLE stays DROP spare")
    e.execute("ALTER TABLE stays ADD age int")
    e.execute("UPDATE stays USING TIMESTAMP 20 SET age = 40 WHERE id = 3")
    e.execute("TRUNCATE emptied")
    e.execute("INSERT INTO emptied (id, name) VALUES (1, 'after')")
    e.execute("DROP TABLE dropped")
    left = e.execute("DESCRIBE TABLES").select(F.col("name").alias("held"), F.lit(-1).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("age"))
    return e.execute("SELECT 'stays' AS held, id, name, age FROM stays").unionByName(e.execute("SELECT 'emptied' AS held, id, name, NULL AS age FROM emptied")).unionByName(left)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, now=NOW)
    e.execute("CREATE TABLE people (city text, id int, name text, tags set<text>, PRIMARY KEY (city, id)) WITH CLUSTERING ORDER BY (id DESC)")
    return e.execute("DESCRIBE people")


def user_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of a user-defined type, written as literals and read by field."""
    e = Engine(spark, now=NOW)
    e.execute("CREATE TYPE place (street text, zip int)")
    e.execute("CREATE TABLE homes (id int PRIMARY KEY, home frozen<place>)")
    e.execute("INSERT INTO homes (id, home) VALUES (1, {street: 'a', zip: 10})")
    e.execute("INSERT INTO homes (id, home) VALUES (2, {street: 'b', zip: 20})")
    return e.execute("SELECT id, home.street AS street, home.zip AS zip FROM homes")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders_table(spark, sf_dir, None)
    e.execute("CREATE INDEX by_state ON kept (state)")
    return e.execute("SELECT cust, id FROM kept WHERE state = 'P'")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a statement says that its filter reaches the scan and that only its columns are read."""
    plan = engine(spark, sf_dir, ("orders",)).execute("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 1000")
    return plan.agg(F.max(F.col("plan").contains("PushedFilters: [IsNotNull(o_totalprice)")).alias("pushed"), F.max(F.col("plan").rlike("ReadSchema: struct<o_orderkey:[a-z]+,o_totalprice:[a-z0-9(,)]+>")).alias("pruned"))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the client gets them: their number, rows and first row."""
    pages = engine(spark, sf_dir, ("nation",)).pages("SELECT n_nationkey FROM nation ORDER BY n_nationkey", 10)
    return spark.createDataFrame([(k, len(p), p[0].n_nationkey) for k, p in enumerate(pages)], "page int, n int, first long")


def client_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the client's calls that give one value."""
    e = engine(spark, sf_dir, ("orders", "nation"))
    return spark.createDataFrame(
        [
            ("count", e.query_count("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")),
            ("exists", int(e.query_exists("SELECT o_orderkey FROM orders WHERE o_orderkey < 0"))),
            ("one", int(e.query_one("SELECT MAX(n_nationkey) AS m FROM nation").m)),
            ("columns", e.query_columns("nation", "n_nationkey", where="n_regionkey = 1").count()),
            ("iterated", sum(int(r.n_nationkey) for r in e.iterate("SELECT n_nationkey FROM nation"))),
        ],
        "call string, value long",
    )


def files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query over several files as one table, found as generations of a folder."""
    folder, o = _folder(spark), read(spark, sf_dir, "orders")
    for k in (1, 2, 10):
        o.filter(F.col("o_orderkey") % 3 == k % 3 if k < 10 else F.col("o_orderkey") % 3 == 0).write.parquet(f"{folder}/gen-{k}.parquet")
    found = readers.generations(spark, folder)
    if list(found) != [1, 2, 10]:
        raise ValueError(f"generations {list(found)}")
    return Engine(spark, now=NOW).query_files("SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderkey) AS last FROM parts GROUP BY o_orderstatus", "parts", *found.values())


def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as YAML text, line by line."""
    text = sinks.format_rows(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "yaml")
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


def column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are in the bins, whose centres lie within the column."""
    o = read(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("price"))
    return stats.histogram(o, "price", 20).agg(F.sum("y").cast("long").alias("n"), F.count(F.lit(1)).alias("bins"))


def _streamed(spark: SparkSession, frame: DataFrame, change: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream over ``frame`` gives once all of it has arrived."""
    folder = _folder(spark)
    frame.write.parquet(f"{folder}/in")
    return tail.arrived(change(tail.read_generations(spark, f"{folder}/in", frame.schema)), mode, f"{folder}/out", f"{folder}/checkpoint")


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events with less than a gap between them."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    got = _streamed(spark, e, lambda s: tail.sessions(s, "ts", "5430500 milliseconds", ["user_id"], late="3650 days"), "complete")
    return got.select("user_id", "n", F.unix_micros("start").alias("begin"))


def streamed_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days that begin each day, with a sum."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    got = _streamed(spark, e, lambda s: tail.windowed(s, "ts", "2 days", value="event_id", late="3650 days", slide="1 day"), "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "total")


def streamed_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that outlive a long time to live and a short one."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    long, short = (_streamed(spark, e, lambda s, t=t: tail.live_only(s, t, "ts"), "append") for t in (100 * 365 * 86_400, 1))
    return long.withColumn("kind", F.lit("long")).unionByName(short.withColumn("kind", F.lit("short"))).select("event_id", "kind")


_KEPT = "SELECT o_custkey::BIGINT AS cust, o_orderkey::BIGINT AS id, o_orderstatus AS state, o_totalprice::DOUBLE AS price FROM orders"


_OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "merge_lww": (merge_lww, f"WITH {_VERSIONS}, c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY generation DESC, write_time DESC, event_id) AS rn FROM v WHERE NOT tombstone) SELECT k, event_id, value FROM c WHERE rn = 1"),
    "merge_tombstones": (merge_tombstones, f"WITH {_VERSIONS}, {_MERGED.format(now=NOW, source='v', key='k')} SELECT k, event_id, value FROM c WHERE rn = 1 AND NOT tombstone AND {_ALIVE.format(now=NOW)}"),
    "merge_ttl": (merge_ttl, f"WITH {_VERSIONS} SELECT event_id, value FROM v WHERE NOT tombstone AND {_ALIVE.format(now=NOW)}"),
    "merge_conflict": (merge_conflict, f"WITH {_VERSIONS}, c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY {_AT} DESC, tombstone DESC, generation DESC) AS rn FROM v) SELECT k, write_time FROM c WHERE rn = 1 AND NOT tombstone AND {_ALIVE.format(now=NOW)}"),
    "gc_tombstones": (gc_tombstones, f"WITH {_VERSIONS} SELECT event_id FROM v WHERE tombstone AND {NOW} - deletion_time > 864000000000"),
    "compaction": (
        compaction,
        f"""WITH {_VERSIONS}, c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY {_AT} DESC, tombstone DESC, generation DESC) AS rn FROM v WHERE NOT tombstone OR ttl IS NULL OR {NOW} <= deletion_time + ttl)
        SELECT k, tombstone, {_AT} AS at FROM c WHERE rn = 1 AND CASE WHEN tombstone THEN {NOW} - deletion_time <= 864000000000 ELSE {_ALIVE.format(now=NOW)} END""",
    ),
    "merge_cells": (
        merge_cells,
        f"""WITH {_VERSIONS}, u AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS col, tombstone AND event_id % 4 = 0 AS rt FROM v),
        r AS (SELECT *, MAX(CASE WHEN rt AND (ttl IS NULL OR {NOW} <= deletion_time + ttl) THEN deletion_time END) OVER (PARTITION BY user_id) AS dead FROM u),
        w AS (SELECT * FROM r WHERE NOT rt AND (dead IS NULL OR {_AT} > dead)), {_MERGED.format(now=NOW, source='w', key='user_id, col')}
        SELECT user_id, MAX(CASE WHEN col = 'even' THEN event_id END) AS even, MAX(CASE WHEN col = 'odd' THEN event_id END) AS odd FROM c WHERE rn = 1 AND NOT tombstone AND {_ALIVE.format(now=NOW)} GROUP BY user_id""",
    ),
    "merge_range_tombstone": (
        merge_range_tombstone,
        f"""WITH {_VERSIONS}, t AS (SELECT user_id, CASE WHEN event_id % 4 > 0 THEN event_id - 500 END AS lo, CASE WHEN event_id % 4 < 3 THEN event_id + 500 END AS hi, deletion_time AS dt FROM v WHERE tombstone AND (ttl IS NULL OR {NOW} <= deletion_time + ttl))
        SELECT user_id, event_id, write_time FROM v r WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = r.user_id AND (lo IS NOT NULL OR hi IS NOT NULL) AND (lo IS NULL OR r.event_id >= lo) AND (hi IS NULL OR r.event_id <= hi) AND dt > r.write_time)""",
    ),
    "merge_collections": (
        merge_collections,
        f"""WITH {_VERSIONS}, c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY {_AT} DESC, tombstone DESC, generation DESC) AS rn FROM v),
        d AS (SELECT k, event_id, list_filter([event_id % 4, event_id % 6, 9], lambda x: x <> event_id % 2) AS tags FROM c WHERE rn = 1 AND NOT tombstone AND {_ALIVE.format(now=NOW)}) SELECT k, event_id, len(tags)::INT AS n, list_min(tags) AS least FROM d""",
    ),
    "counter_merge": (counter_merge, "SELECT user_id, SUM(event_id % 5 - 2)::BIGINT AS delta FROM events GROUP BY user_id"),
    "collection_changes": (
        collection_changes,
        """SELECT o_orderkey, array_to_string(l || ['F', 'z'], ',') AS appended, array_to_string(['F', 'z'] || l, ',') AS prepended, array_to_string(list_filter(l, lambda x: x NOT IN ('F', 'z')), ',') AS removed,
        array_to_string(list_sort(list_distinct(l || ['F', 'z'])), ',') AS added FROM (SELECT o_orderkey, [o_orderstatus, o_orderpriority] AS l FROM orders)""",
    ),
    "partition_scan": (partition_scan, "SELECT event_id, ts FROM events WHERE user_id = 7"),
    "point_get": (point_get, "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1"),
    "clustering_range": (clustering_range, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderdate <= '1998-01-01' AND o_orderdate >= '1994-01-01'"),
    "latest_per_key": (latest_per_key, "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"),
    "static_broadcast": (static_broadcast, "SELECT conv_id, turn, MAX(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS mark FROM conversations"),
    "table_stats": (table_stats, "SELECT SUM(n)::BIGINT AS n_rows, COUNT(*) AS n_partitions, MAX(n) AS largest_partition FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id)"),
    "column_stats": (
        column_stats,
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_null, COUNT(DISTINCT {c}) AS n_distinct, MIN({c})::VARCHAR AS least, MAX({c})::VARCHAR AS greatest FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_custkey")),
    ),
    "multi_generation_union": (multi_generation_union, "SELECT event_id, user_id, value, 1 AS generation FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, NULL, 2 FROM events WHERE event_id % 2 = 1"),
    "multi_file_count": (multi_file_count, "SELECT ((SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM part))::BIGINT AS n"),
    "token_ranges": (token_ranges, "SELECT event_id FROM events"),
    "stored_reopened": (stored_reopened, f"{_KEPT} UNION ALL SELECT -1, -1, 'new', NULL"),
    "stored_compacted": (stored_compacted, f"SELECT cust, id, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'later' ELSE state END AS state, price FROM ({_KEPT})"),
    "stored_range_delete": (stored_range_delete, f"SELECT * FROM ({_KEPT}) WHERE NOT (cust = 7 AND id > 0 AND id <= 100000) UNION ALL SELECT 7, 51, 'new', NULL"),
    "stored_update": (stored_update, f"SELECT cust, id, state, CASE WHEN cust = 7 THEN price * 2 ELSE price END AS price FROM ({_KEPT}) WHERE NOT (cust = 8 AND state = 'F')"),
    **{f"export_{f}": (_round_trip(f), "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer") for f in ("csv", "json", "parquet", "orc")},
    "export_insert": (insert_export, "SELECT 'INSERT INTO nation (n_nationkey, n_name) VALUES (' || n_nationkey || ', ''' || n_name || ''');' AS value FROM nation"),
    "import_csv": (import_csv, "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation"),
    "insert_json_batch": (insert_json, "SELECT 1 AS id, 'c' AS name UNION ALL SELECT 2, 'b'"),
    "merge_map_collections": (
        merge_map_collections,
        f"""WITH {_VERSIONS}, c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY {_AT} DESC, tombstone DESC, generation DESC) AS rn FROM v)
        SELECT k, event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN event_id % 2 = 0 THEN event_id + 1 ELSE event_id END AS least FROM c WHERE rn = 1 AND NOT tombstone AND {_ALIVE.format(now=NOW)}""",
    ),
    "streamed_upsert": (
        streamed_upsert,
        f"""WITH {_VERSIONS}, c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY {_AT} DESC, tombstone DESC) AS rn FROM v WHERE NOT tombstone OR ttl IS NULL OR {NOW} <= deletion_time + ttl)
        SELECT k, write_time FROM c WHERE rn = 1 AND NOT tombstone AND {_ALIVE.format(now=NOW)}""",
    ),
    "streamed_windows": (streamed_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS n FROM events GROUP BY ALL"),
    "streamed_sessions": (
        streamed_sessions,
        """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 5430500000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, COUNT(*) AS n, epoch_us(MIN(ts)) AS begin FROM s GROUP BY user_id, k""",
    ),
    "streamed_sliding": (
        streamed_sliding,
        """SELECT strftime(day, '%Y-%m-%d') AS day, COUNT(*) AS n, SUM(event_id)::BIGINT AS total
        FROM (SELECT unnest([CAST(ts AS DATE), CAST(ts AS DATE) - 1]) AS day, event_id FROM events) GROUP BY day""",
    ),
    "streamed_ttl": (streamed_ttl, "SELECT event_id, 'long' AS kind FROM events"),
    "prepared": (prepared, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (7, 8, 10) OR o_orderstatus = 'O' AND o_custkey = 7"),
    "table_lifecycle": (
        table_lifecycle,
        """SELECT 'stays' AS held, n_nationkey::INT AS id, n_name AS name, CASE WHEN n_nationkey = 3 THEN 40 END AS age FROM nation
        UNION ALL SELECT 'emptied', 1, 'after', NULL UNION ALL SELECT unnest(['main.emptied', 'main.stays']), -1, NULL, NULL""",
    ),
    "described": (
        described,
        """SELECT * FROM (VALUES ('city', 'text', 'partition', 0), ('id', 'int', 'clustering desc', 1), ('name', 'text', 'regular', 2), ('tags', 'set<text>', 'regular', 3)) t("name", "type", "role", "position")""",
    ),
    "user_type": (user_type, "SELECT * FROM (VALUES (1, 'a', 10), (2, 'b', 20)) t(id, street, zip)"),
    "indexed": (indexed, f"SELECT cust, id FROM ({_KEPT}) WHERE state = 'P'"),
    "explained": (explained, "SELECT TRUE AS pushed, TRUE AS pruned"),
    "paged": (paged, "SELECT (k // 10)::INT AS page, COUNT(*)::INT AS n, MIN(n_nationkey)::BIGINT AS first FROM (SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) GROUP BY k // 10"),
    "client_calls": (
        client_calls,
        """SELECT 'count' AS call, COUNT(*)::BIGINT AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'exists', 0 UNION ALL SELECT 'one', MAX(n_nationkey)::BIGINT FROM nation
        UNION ALL SELECT 'columns', COUNT(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'iterated', SUM(n_nationkey)::BIGINT FROM nation""",
    ),
    "files_query": (files_query, "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderkey) AS last FROM orders GROUP BY o_orderstatus"),
    "displayed": (displayed, """SELECT '- n_nationkey: ' || n_nationkey AS line FROM nation UNION ALL SELECT '  n_name: "' || n_name || '"' FROM nation"""),
    "column_histogram": (column_histogram, "SELECT COUNT(*) AS n, LEAST(20, COUNT(DISTINCT o_totalprice)) AS bins FROM orders"),
    "stored_table": (stored_table, "SELECT n_regionkey AS region, n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_nationkey = 1 AND n_regionkey = 1 THEN 2.5 ELSE 1.0 END::DOUBLE AS score FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 2, 900, 'new', NULL"),
}


def _statement(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    tree = parse(text)
    named = {x.name.lower() for x in walk(tree) if isinstance(x, Table)}
    needed = TABLES if "system.tables" in named else tuple(t for t in TABLES if t in named)
    return lambda spark, sf_dir: engine(spark, sf_dir, needed).execute(text, _PARAMS.get(name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: _statement(n, t) for n, t in _SAME.items()}
    out |= {n: _statement(n, t[0]) for n, t in _PAIRS.items()}
    return out | {n: f for n, (f, _) in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return _SAME | {n: t[1] for n, t in _PAIRS.items()} | {n: q for n, (_, q) in _OPERATORS.items()}
