"""Mixing sources to target weights by iterative proportional fitting (operator 6).

Tokens are summed by cell (source, language, topic). Each cell's probability of being drawn is raked in turn to the target
shares of sources, languages and topics in the drawn tokens, with 1 as its bound at every step: where a cell is full, the others
of its category make up for it. A category that holds fewer tokens than its share of the budget gives all it has, and the rest
goes to the others. Documents are drawn by a hash of doc_id. All cells fit the driver up to MAX_CELLS; beyond that the raking
runs as DataFrames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, drop, fresh

DIMS = ("source", "lang", "topic")
#: Target shares are token shares to these powers, scaled to 1: 1 keeps the shares as they are, 0 makes all equal.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS, SCALE_ROUNDS, BUDGET = 20, 6, 0.5
MAX_CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def tokens(text=None):
    return F.regexp_count(_text() if text is None else text, F.lit(WORD)).cast("long")


def topic(n_tokens):
    """A topic by the form of the text: share of bars, of symbols, of digits, then length."""
    t = _text()
    n = F.length(t)
    share = lambda chars: F.regexp_count(t, F.lit(chars))
    return F.when(n_tokens == 0, "empty").when(share("[|]") * 40 >= n, "table").when(share("[$%&#*!]") * 25 >= n, "symbols").when(share("[0-9]") * 25 >= n, "numbers").when(n_tokens >= 400, "long").otherwise("short")


def tagged(docs: DataFrame, source: str, lang: str) -> DataFrame:
    """``docs`` with n_tokens, topic and, under the given names, the cell's source and language; a null one is a category of its own, named (null)."""
    base = docs.drop("n_tokens", "topic").withColumn("n_tokens", tokens())
    return base.withColumns({"topic": topic(F.col("n_tokens")), source: F.coalesce(F.col("source"), F.lit("(null)")), lang: F.coalesce(F.col("lang"), F.lit("(null)"))})


def _cells(rows: DataFrame, source: str, lang: str) -> DataFrame:
    return rows.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), "topic").agg(F.sum("n_tokens").cast("double").alias("tokens"))


def _goal(share: np.ndarray, wanted: np.ndarray, budget: float) -> np.ndarray:
    """Shares of all tokens that categories give to the draw: as wanted, up to what they hold, the rest in the same proportions; they sum to the budget."""
    total = wanted.sum()
    if total <= 0:
        return share * budget
    factor = budget / total
    for _ in range(SCALE_ROUNDS):
        full = wanted * factor >= share
        free, open_ = wanted[~full].sum(), budget - share[full].sum()
        if free <= 0 or open_ <= 0:
            break
        factor = open_ / free
    return np.minimum(share, wanted * factor)


def rake(cells: dict[str, np.ndarray], tokens_: np.ndarray, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Weights (probabilities over the budget) and probabilities of the cells. Targets not given are token shares to POWERS."""
    total = tokens_.sum()
    p = np.full(len(tokens_), budget)
    if total <= 0:
        return np.ones(len(tokens_)), p
    codes, goals = {}, {}
    for d in DIMS:
        names, codes[d] = np.unique(cells[d], return_inverse=True)
        share = np.bincount(codes[d], tokens_, len(names)) / total
        wanted = share ** POWERS[d] * (share > 0) if not targets or d not in targets else np.array([targets[d].get(x, 0.0) for x in names])
        goals[d] = _goal(share, wanted, budget)
    for _ in range(rounds):
        for d in DIMS:
            now = np.bincount(codes[d], tokens_ * p, len(goals[d]))
            factor = np.divide(goals[d] * total, now, out=np.ones_like(now), where=now > 0)
            p = np.minimum(1.0, p * factor[codes[d]])
    return p / budget, p


def rake_frames(cells: DataFrame, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """The same as ``rake`` for any number of cells, as DataFrames: cells with weight and probability."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    out = cells.withColumn("probability", F.lit(budget))
    if total <= 0:
        return out.withColumn("weight", F.lit(1.0))
    goals = {}
    for d in DIMS:
        g = cut(cells.groupBy(d).agg((F.sum("tokens") / total).alias("share")).withColumn("wanted", F.when(F.col("share") > 0, F.pow("share", F.lit(POWERS[d]))).otherwise(0.0)))
        factor = budget / g.agg(F.sum("wanted")).first()[0]
        for _ in range(SCALE_ROUNDS):
            full = F.col("wanted") * factor >= F.col("share")
            r = g.agg(F.sum(F.when(full, 0.0).otherwise(F.col("wanted"))).alias("free"), F.sum(F.when(full, F.col("share")).otherwise(0.0)).alias("full")).first()
            if r["free"] <= 0 or budget - r["full"] <= 0:
                break
            factor = (budget - r["full"]) / r["free"]
        goals[d] = g.select(d, F.least("share", F.col("wanted") * factor).alias("goal"))
    for _ in range(rounds):
        last = out
        for d in DIMS:
            now = out.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("now"))
            factor = now.join(goals[d], d, "left").select(d, F.when(F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) * total / F.col("now")).otherwise(1.0).alias("factor"))
            out = out.join(factor, d).withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.col("factor"))).drop("factor")
        out = cut(out)
        drop(last)
    return out.withColumn("weight", F.col("probability") / budget)


def uniform(seed: int = 0):
    """A number in [0, 1) from doc_id: equal ids, equal draws."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 0, max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` with n_tokens, topic, weight, probability and sampled (1 or 0).

    Every document takes part in the sums; null texts have no tokens, and a cell without tokens follows its categories. Rows
    that repeat a doc_id share a draw. Columns of ``docs`` with these names are replaced; all others stay. An empty table
    gives an empty table.
    """
    source, lang = fresh(docs, "__source", "__lang")
    rows = tagged(docs, source, lang)
    cells = _cells(rows, source, lang)
    got = cells.limit(max_cells + 1).toPandas()
    if len(got) > max_cells:
        if targets:
            raise ValueError("own targets need cells within max_cells")
        table = rake_frames(cut(cells), budget=budget).select(*DIMS, "weight", "probability")
    else:
        weight, p = rake({d: got[d].to_numpy(object).astype(str) for d in DIMS}, got["tokens"].to_numpy(float), targets, budget=budget)
        got["weight"], got["probability"] = weight, p
        table = F.broadcast(docs.sparkSession.createDataFrame(list(got[[*DIMS, "weight", "probability"]].itertuples(index=False, name=None)), "source string, lang string, topic string, weight double, probability double"))  # max_cells rows
    table = table.withColumnsRenamed({"source": source, "lang": lang})
    base = [c for c in docs.columns if c not in ("n_tokens", "topic", "weight", "probability", "sampled")]
    out = rows.drop("weight", "probability", "sampled").join(table, [source, lang, "topic"], "left")
    return out.select(*base, "n_tokens", "topic", "weight", "probability", (uniform(seed) < F.col("probability")).cast("int").alias("sampled"))


def oracle() -> str:
    """The same in SQL for DuckDB, the rounds written out."""
    n = "length(t)"
    share = lambda chars: f"({n} - length(translate(t, '{chars}', '')))"
    sql = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, t, len(regexp_extract_all(t, '{WORD}')) AS n_tokens
        FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
        e AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'empty' WHEN {share("|")} * 40 >= {n} THEN 'table' WHEN {share("$%&#*!")} * 25 >= {n} THEN 'symbols'
        WHEN {share("0123456789")} * 25 >= {n} THEN 'numbers' WHEN n_tokens >= 400 THEN 'long' ELSE 'short' END AS topic FROM d),
        w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, {BUDGET}::DOUBLE AS p FROM e GROUP BY ALL),
        total AS MATERIALIZED (SELECT sum(tokens) AS total FROM w0)"""
    ]
    for x in DIMS:
        sql.append(f"h_{x} AS MATERIALIZED (SELECT {x}, share, CASE WHEN share > 0 THEN pow(share, {POWERS[x]}) ELSE 0 END AS wanted FROM (SELECT {x}, sum(tokens) / (SELECT total FROM total) AS share FROM w0 GROUP BY {x}))")
        sql.append(f"f_{x}_0 AS MATERIALIZED (SELECT {BUDGET} / sum(wanted) AS f FROM h_{x})")
        for i in range(SCALE_ROUNDS):
            sql.append(f"""f_{x}_{i + 1} AS MATERIALIZED (SELECT CASE WHEN free > 0 AND room > 0 THEN room / free ELSE f END AS f FROM (SELECT any_value(f) AS f, sum(CASE WHEN wanted * f >= share THEN 0 ELSE wanted END) AS free,
            {BUDGET} - sum(CASE WHEN wanted * f >= share THEN share ELSE 0 END) AS room FROM h_{x}, f_{x}_{i}))""")
        sql.append(f"g_{x} AS MATERIALIZED (SELECT {x}, least(share, wanted * f) AS goal FROM h_{x}, f_{x}_{SCALE_ROUNDS})")
    k = 0
    for _ in range(ROUNDS):
        for x in DIMS:
            sql.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(1.0, p * CASE WHEN now > 0 THEN goal * total / now ELSE 1 END) AS p FROM (SELECT w.*, g.goal, sum(tokens * p) OVER (PARTITION BY w.{x}) AS now FROM w{k} w JOIN g_{x} g USING ({x})), total)")
            k += 1
    return (
        "WITH "
        + ",\n".join(sql)
        + f""" SELECT e.doc_id, e.source, e.lang, e.topic, e.n_tokens, round(p / {BUDGET}, 6) AS weight, round(p, 6) AS probability,
        (('0x' || substr(md5(coalesce(e.doc_id::VARCHAR, '') || ':0'), 1, 8))::BIGINT / 4294967296.0 < p)::INT AS sampled
        FROM e JOIN w{k} w USING (source, lang, topic)"""
    )
