"""Benchmark decontamination by spaced-seed hashing (operator 2), in DataFrame functions only.

Words are hashed once; a seed hashes the words that a fixed mask selects, so a changed word at an ignored position does not
hide an overlap. Seeds of documents meet those of the benchmark by hash; around each hit both texts are compared word for
word on the hit's diagonal, and the best stretch counts, a match 1 and a substitution -2. An item is found in a document if
the stretch scores ENOUGH, or SHARE of the item's words, or if WHOLE of its words match on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, fresh

#: 1: the word counts, 0: it is ignored.
MASKS = ("1101011", "1110011", "11011001")
#: Items of fewer words are too common to prove anything; those below LONG words must occur whole, word for word.
LEAST, LONG = 5, 8
SUBSTITUTION, ENOUGH, SHARE, WHOLE = -2, 13, 0.7, 0.8
#: The benchmark's seeds are broadcast up to so many words of it, about 200 MB; beyond, hits are found by a shuffle.
BROADCAST_WORDS = 1_000_000
SPLIT = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks(short: list[int]) -> list[tuple[int, str]]:
    """(number, mask); items below LONG words have a mask of their own length, without ignored positions."""
    return list(enumerate(MASKS)) + [(100 + n, "1" * n) for n in sorted(short)]


def _seeds(words: str, pos: str, chosen: list[tuple[int, str]], whole: bool = False) -> Column:
    """The seeds that begin at a position, null where the mask would pass the end; ``whole``: a short item's own mask only."""
    out, n = [], F.size(words)
    for k, mask in chosen:
        h = F.xxhash64(F.lit(k), *[F.get(F.col(words), F.col(pos) + i) for i, bit in enumerate(mask) if bit == "1"])
        fits = (F.col(pos) + len(mask) <= n) & ((n == len(mask) if k >= 100 else n >= LONG) if whole else F.lit(True))
        out.append(F.when(fits, h))
    return F.array(*out)


def _verify(words: str) -> Column:
    """Best stretch of the item on the diagonal: (score, matches)."""
    item = F.col("__item")
    equal = F.transform(F.sequence(F.lit(0), F.size(item) - 1), lambda j: F.coalesce(F.get(F.col(words), F.col("__diagonal") + j) == F.get(item, j), F.lit(False)))
    zero = F.lit(0)

    def step(acc: Column, same: Column) -> Column:
        run = F.greatest(zero, acc["run"] + F.when(same, 1).otherwise(SUBSTITUTION))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"), (acc["n"] + same.cast("int")).alias("n"))

    return F.aggregate(equal, F.struct(zero.alias("run"), zero.alias("best"), zero.alias("n")), step)


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Pairs (doc_id, item_id, score, n_match, item_words), one for each item found in a document.

    Null or empty texts hold nothing; null ids are kept as ids; rows that repeat an id count as one document; whole texts are
    searched. Items of fewer than LEAST words are not searched. Copies of an item give a pair each.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("__item")).filter(F.size("__item") >= LEAST).distinct()
    size = items.agg(F.coalesce(F.sum(F.size("__item")), F.lit(0)).alias("n"), F.collect_set(F.when(F.size("__item") < LONG, F.size("__item"))).alias("short")).first()
    chosen = masks(size["short"])
    seeds = items.select("item_id", "__item", F.posexplode("__item").alias("__at", "__w")).select("item_id", "__item", "__at", F.explode(_seeds("__item", "__at", chosen, whole=True)).alias("__seed")).filter("__seed is not null").dropDuplicates(["item_id", "__at", "__seed"])
    words = docs.select("doc_id", word_hashes(F.col("text")).alias("__words"))  # outer below: else a filter would split each text twice
    places = words.select("doc_id", "__words", F.posexplode_outer("__words").alias("__pos", "__w")).select("doc_id", "__words", "__pos", F.explode(_seeds("__words", "__pos", chosen)).alias("__seed")).filter("__seed is not null")
    diagonal = (F.col("__pos") - F.col("__at")).alias("__diagonal")
    if size["n"] <= broadcast_words:
        by_seed = F.broadcast(seeds.select("__seed", "item_id", "__at"))
        by_item = F.broadcast(items)
        hits = places.join(by_seed, "__seed").select("doc_id", "__words", "item_id", diagonal).join(by_item, "item_id")
        found = hits.select("doc_id", "item_id", F.size("__item").alias("item_words"), _verify("__words").alias("__v"))
    else:
        pairs = places.select("doc_id", "__pos", "__seed").join(seeds.select("__seed", "item_id", "__at"), "__seed").select("doc_id", "item_id", diagonal).distinct()
        hits = pairs.join(items, "item_id").withColumnRenamed("doc_id", "__d").join(words, F.col("__d").eqNullSafe(F.col("doc_id")))
        found = hits.select("doc_id", "item_id", F.size("__item").alias("item_words"), _verify("__words").alias("__v"))
    best = found.groupBy("doc_id", "item_id", "item_words").agg(F.max("__v.best").alias("score"), F.max("__v.n").alias("n_match"))
    out = best.select("doc_id", "item_id", "score", "n_match", "item_words")
    share = F.col("score") * 10 >= F.col("item_words") * int(SHARE * 10)
    return out.filter((F.col("score") >= ENOUGH) | share | (F.col("n_match") * 10 >= F.col("item_words") * int(WHOLE * 10)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_ids: int = 2_000_000) -> DataFrame:
    """``docs`` without those in which an item was found; a row whose doc_id is null goes if any such row holds an item.

    Null and empty texts stay; rows that repeat an id go or stay together; all columns stay as they are, whatever their names.
    An empty table of either kind removes nothing.
    """
    name = fresh(docs, "__bad")[0]
    bad = cut(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct())  # kept, so that the texts are searched once
    few = bad.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


def oracle() -> str:
    """The same pairs in SQL for DuckDB; seeds are compared as words, not as hashes."""
    split = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{SPLIT}'), lambda x: x <> '')"
    key = lambda mask: " || ' ' || ".join(f"w[p + {i + 1}]" for i, b in enumerate(mask) if b == "1")
    spaced = lambda table, ident: " UNION ALL ".join(f"SELECT {ident}, p, {k} AS m, {key(x)} AS s FROM {table} WHERE p + {len(x)} <= len(w)" + (f" AND len(w) >= {LONG}" if table == "ip" else "") for k, x in enumerate(MASKS))
    whole = " UNION ALL ".join(f"SELECT item_id, p, {100 + n} AS m, {key('1' * n)} AS s FROM ip WHERE p = 0 AND len(w) = {n}" for n in range(LEAST, LONG))
    own = " UNION ALL ".join(f"SELECT doc_id, p, {100 + n} AS m, {key('1' * n)} AS s FROM dp WHERE p + {n} <= len(w)" for n in range(LEAST, LONG))
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {split} AS w FROM documents), i AS MATERIALIZED (SELECT DISTINCT item_id, {split} AS w FROM benchmark),
    dp AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d), ip AS (SELECT item_id, w, unnest(range(len(w))) AS p FROM i WHERE len(w) >= {LEAST}),
    ds AS ({spaced("dp", "doc_id")} UNION ALL {own}), s AS ({spaced("ip", "item_id")} UNION ALL {whole}),
    c AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, ds.p - s.p AS g FROM ds JOIN s USING (m, s)),
    e AS (SELECT c.doc_id, c.item_id, g, len(i.w) AS n, unnest(range(len(i.w))) AS j, d.w AS dw, i.w AS iw FROM c JOIN d USING (doc_id) JOIN i USING (item_id)),
    q AS (SELECT doc_id, item_id, g, n, j, CASE WHEN g + j >= 0 AND g + j < len(dw) AND dw[g + j + 1] = iw[j + 1] THEN 1 ELSE 0 END AS same FROM e),
    r AS (SELECT *, sum(CASE WHEN same = 1 THEN 1 ELSE {SUBSTITUTION} END) OVER (PARTITION BY doc_id, item_id, g ORDER BY j) AS t FROM q),
    b AS (SELECT *, least(0, coalesce(min(t) OVER (PARTITION BY doc_id, item_id, g ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM r),
    x AS (SELECT doc_id, item_id, g, n, greatest(0, max(t - low)) AS score, sum(same) AS n_match FROM b GROUP BY ALL),
    y AS (SELECT doc_id, item_id, n, max(score) AS score, max(n_match) AS n_match FROM x GROUP BY ALL)
    SELECT doc_id, item_id, score::INT AS score, n_match::INT AS n_match, n::INT AS item_words FROM y WHERE score >= {ENOUGH} OR score * 10 >= n * {int(SHARE * 10)} OR n_match * 10 >= n * {int(WHOLE * 10)}"""
