import collections
import os
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import order_minhash as O
from lamina.llm import pii as P
from lamina.llm import queries as Q
from lamina.llm import raking as K
from lamina.llm import reshard as H

duckdb = pytest.importorskip("duckdb")


# ---------------------------------------------------------------- near-duplicates


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(600):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b.insert(k, rng.choice("xyz"))
            elif b:
                b.pop(min(k, len(b) - 1))
        m, k, d = rng.randint(0, 40), rng.randint(1, 20), distance(a, b)
        assert O.banded_distance(a, b, m) == min(d, m + 1)
        e = O._band(a, b, k)
        assert e == d if d <= k else e > k


def classes_of(rows):
    text = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        text.setdefault(t or "", d)
    shingles = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t, d in text.items()}
    at = collections.defaultdict(list)
    for d, s in shingles.items():
        for x in s:
            at[x].append(d)
    near = {(a, b) for ds in at.values() for i, b in enumerate(ds) for a in ds[:i]}
    back = {d: t for t, d in text.items()}
    parent = {d: d for d in back}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        if O.similar(back[a].encode(), back[b].encode()):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: find(text[t or ""]) for d, t in rows}


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in O.near_duplicates(docs).collect()}
    assert got == classes_of([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert O.drop_near_duplicates(docs).count() == len(set(got.values()))


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(k, " ".join(w if rng.random() > 0.03 else f"v{rng.randrange(99999)}" for w in base)) for k in range(300)]
    rows += [(1000 + k, " ".join(f"u{rng.randrange(99999)}" for _ in range(80))) for k in range(50)]
    got = O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0} and all(r.class_id == r.doc_id for r in got if r.doc_id >= 1000)


def test_every_fifth_word_changed(spark):
    word = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(word)), (2, " ".join(w if i % 5 else f"x{i}" for i, w in enumerate(word))), (3, " ".join(w if i % 5 else f"y{i}" for i, w in enumerate([*word, "z"])))]
    got = {r.doc_id: r.class_id for r in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_meetings_are_listed_and_given_out_a_few_at_a_time():
    rng, n, kinds = np.random.default_rng(4), 1200, 60
    has = rng.random((n, kinds)) < 1 / 3  # some 4,800,000 meetings of over 700,000 pairs
    words, label = rng.integers(90, 130, n).astype(np.int32), np.arange(n, dtype=np.int64) // 2
    blocks = []
    for lo in range(0, n, 400):
        row, x = np.nonzero(has[lo : lo + 400])
        blocks.append(O.pack(x=x.astype(np.uint32), row=row.astype(np.uint16), side=np.zeros(len(x), np.uint8), node=np.arange(lo, lo + 400), label=label[lo : lo + 400], words=words[lo : lo + 400]))
    shared, need, most = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64), 0
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for a, b, times, least in O._meetings(blocks, 0.8):
        most = max(most, len(a))
        np.add.at(shared, (a, b), times)
        need[a, b] = least
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    i, j = np.triu_indices(n, 1)
    longer, shorter = np.maximum(words[i], words[j]), np.minimum(words[i], words[j])
    ok = (label[i] != label[j]) & (shorter >= longer - (0.2 * longer + 1e-9).astype(int))
    i, j = i[ok], j[ok]
    want = np.zeros((n, n), np.int64)
    want[i, j] = (has.astype(np.int64) @ has.T.astype(np.int64))[i, j]
    assert (shared == want).all()
    extra = O._extra(words.astype(np.int64), 0.8, O._width(0.8))
    met = want > 0
    assert (need == np.where(met, 1 + np.minimum(extra[:, None], extra[None, :]), 0)).all()
    assert most <= 50_000
    assert peak < 60e6, peak


def test_counted_pairs_add_up():
    rng = np.random.default_rng(5)
    code, times, want = np.zeros(0, np.int64), np.zeros(0, np.int32), collections.Counter()
    for sizes in ([], [0], [3, 0, 7], [200, 100], [1], [400]):
        waiting = [np.sort(rng.integers(0, 250, k)) for k in sizes]
        want.update(x for w in waiting for x in w.tolist())
        code, times = O._counted(code, times, waiting)
        assert not waiting and dict(zip(code.tolist(), times.tolist(), strict=True)) == want and (np.diff(code) > 0).all()


def test_all_pairs_around_one_passage(spark, monkeypatch):
    rng = random.Random(11)
    shared, rows = [f"p{i}" for i in range(60)], []
    for g in range(60):
        own = [f"g{g}w{i}" for i in range(rng.randint(5, 80))]
        for _ in range(5):
            text = [f"n{rng.randrange(10**6)}" if rng.random() < 0.18 else w for w in own]
            rows.append((len(rows), " ".join(text if g % 3 == 0 else shared + text)))
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if O.similar(rows[a][1].encode(), rows[b][1].encode()):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)

    def find(x):
        return x if parent[x] == x else find(parent[x])

    monkeypatch.setattr(O, "BLOCK", 20)
    got = {r.doc_id: r.class_id for r in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in range(len(rows))}
    members = O._members
    monkeypatch.setattr(O, "_members", lambda groups: members(groups).filter("bucket is null"))  # all is left to the exact join
    got = {r.doc_id: r.class_id for r in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in range(len(rows))}


def test_near_odd_rows(spark, odd):
    got = {r.doc_id: r.class_id for r in O.near_duplicates(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 10}
    kept = O.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 4, None, 5, 7, 8, 9, 10]))
    assert O.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 103), (102, 103)]
    got = {r.node: r.label for r in O.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 103: 100}


# ---------------------------------------------------------------- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d, s = re.sub("[^0-9]", "", m[0]), 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (1 + i % 2)
            s += x - 9 if x > 9 else x
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(2)
    for k in range(8000):
        t = "".join(rng.choice("ab@..-+ 0123456789( )" if k % 2 else "a@.1 -é+") for _ in range(rng.randint(0, 60)))
        assert P.base_spans(t) == plain_spans(t)


def test_long_runs_take_no_quadratic_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 70_000, "a1" * 100_000):
        P.base_spans(t)
        P.Graph([t])


def test_repeats_get_the_label(spark, docs):
    field = P.fit(docs)
    t = "Call +49 170 1234567 at once; or 491701234567 if that fails. Order 55123 is another matter."
    g = P.Graph([t])
    assert [(k, t[a:b]) for k, a, b in field.added(g)[0]] == [("phone", "491701234567")]
    alone = P.Graph(["Order 491701234567 is ready, as is 491701234567 again."])
    assert field.added(alone) == [[]]


def test_every_one_of_many_repeats_gets_the_label(spark, docs):
    field = P.fit(docs)
    text = lambda n, at: " ".join("Call +49 170 1234567 at once." if k == at else f"Entry {k}: see 491701234567 there." for k in range(n))
    for n, at in ((51, 0), (51, 25), (51, 50), (400, 0)):
        t = text(n, at)
        assert [t[a:b] for _, a, b in field.added(P.Graph([t]))[0]] == ["491701234567"] * (n - 1)
    # A document's result does not depend on those it is computed with.
    texts = [text(51, 7), "Order 491701234567 is ready, as is 491701234567 again.", None, "", text(9, 3)]
    assert field.added(P.Graph(texts)) == [field.added(P.Graph([t]))[0] for t in texts]


def test_beliefs_on_a_tree_equal_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(20):
        g = P.Graph([])
        n = int(rng.integers(2, 6))
        g.base, g.doc, g.given = [[]], [0] * n, np.zeros(n, int)
        g.x = (rng.random((n, P.FEATURES)) < 0.2).astype(np.uint8)
        for k in range(1, n):
            g.edges[int(rng.integers(2))].append((int(rng.integers(k)), k))
        even = lambda q: (q + q.T) / 2
        field = P.Field(rng.normal(size=(P.FEATURES, P.LABELS)) / 3, *(even(rng.normal(size=(P.LABELS, P.LABELS))) for _ in "ab"))
        score, want = g.x @ field.unary, np.zeros((n, P.LABELS))
        for labels in np.ndindex(*[P.LABELS] * n):
            z = sum(score[k, x] for k, x in enumerate(labels))
            z += sum(q[labels[a], labels[b]] for edges, q in zip(g.edges, (field.chain, field.skip), strict=True) for a, b in edges)
            want[range(n), labels] += np.exp(z)
        assert np.abs(field.beliefs(g) - want / want.sum(1, keepdims=True)).max() < 0.01


def test_pii_odd_rows(spark, odd, docs):
    got = P.find_personal_data(odd, P.fit(odd)).collect()
    assert len(got) == 12 and all(r.n_email == 0 for r in got) and P.find_personal_data(odd.limit(0), P.fit(odd.limit(0))).count() == 0
    assert P.redact("mail a@b.cc now", [("email", 5, 11)]) == "mail [email] now"


# ---------------------------------------------------------------- mixing


def test_raking_against_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(c.sql(K.oracle()).fetchall())
    got = sorted(tuple(r) for r in Q.op6_raking(spark, d).collect())
    assert [g[:5] + g[7:] for g in got] == [w[:5] + w[7:] for w in want]
    assert np.allclose([g[5:7] for g in got], [w[5:7] for w in want], atol=2e-6)


def test_raking_meets_marginals(spark):
    rng = np.random.default_rng(0)
    cells = {d: rng.integers(0, n, 300).astype(str) for d, n in (("source", 4), ("lang", 3), ("topic", 3))}
    tokens = rng.integers(1, 1000, 300).astype(float)
    goal = {"source": {"0": 0.4, "1": 0.3, "2": 0.2, "3": 0.1}}
    w, p = K.rake(cells, tokens, goal, rounds=60, budget=0.2)
    for s, share in goal["source"].items():
        assert abs((w * tokens)[cells["source"] == s].sum() / tokens.sum() - share) < 1e-3
    assert abs((p * tokens).sum() / tokens.sum() - 0.2) < 1e-6 and p.max() <= 1


def test_raking_as_frames(spark, docs):
    one, two = K.mix_sources(docs), K.mix_sources(docs, max_cells=0)
    key = lambda df: {r.doc_id: (round(r.weight, 8), round(r.probability, 8), r.sampled) for r in df.collect()}
    assert key(one) == key(two)


def test_mixing_odd_rows(spark, odd):
    got = K.mix_sources(odd).collect()
    assert len(got) == 12 and all(0 <= r.probability <= 1 for r in got) and K.mix_sources(odd.limit(0)).count() == 0


def test_drawn_tokens_meet_targets(spark):
    """Marginals of what is drawn, not of the weights; the raked shares of a category are capped by what it holds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = K.mix_sources(docs).toPandas()
    total = got.n_tokens.sum()
    for d in K.DIMS:
        held = got.assign(**{d: got[d].fillna("(null)")}).groupby(d)
        share = (held.n_tokens.sum() / total).to_numpy()
        goal = K._goal(share, share ** K.POWERS[d] * (share > 0), K.BUDGET)
        drawn = held.apply(lambda g: (g.probability * g.n_tokens).sum() / total, include_groups=False).to_numpy()
        assert abs(drawn - goal).max() < 0.005 * K.BUDGET
    assert got.probability.max() <= 1


# ---------------------------------------------------------------- sharding


def test_transport_is_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(20):
        supply, n, m = rng.integers(0, 9, 3).tolist(), 3, 3
        cap = rng.integers(0, 9, m).tolist()
        cap[0] += max(0, sum(supply) - sum(cap))
        cost = rng.integers(0, 5, (n, m))
        flow = H.transport(supply, cap, cost)
        assert flow.sum(1).tolist() == supply and all(f <= c for f, c in zip(flow.sum(0), cap, strict=True)) and (flow >= 0).all()
        unit = [(i, j) for i in range(n) for j in range(m)]
        best = _least(supply, cap, cost)
        assert sum(flow[i, j] * cost[i, j] for i, j in unit) == best
    with pytest.raises(ValueError):
        H.transport([5], [4], np.zeros((1, 1)))


def _least(supply, cap, cost):
    import functools

    units = [i for i, s in enumerate(supply) for _ in range(s)]

    @functools.cache
    def go(k, room):
        if k == len(units):
            return 0
        return min((cost[units[k], j] + go(k + 1, room[:j] + (room[j] - 1,) + room[j + 1 :]) for j in range(len(room)) if room[j]), default=10**9)

    return go(0, tuple(cap))


def test_shards(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op9_min_cost_resharding(spark, d).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 1000 and set(got["shard"]) == set(range(40)) and sizes.max() - sizes.min() < 100
    slots = got.groupby("shard").slot
    assert (slots.min() == 0).all() and (slots.max() + 1 == slots.count()).all() and slots.nunique().sum() == 1000
    home = got.groupby(["text_crc32", "size"]).agg(n=("shard", "nunique"), total=("size", "sum"))
    assert (home.n[home.total <= sizes.mean() / 4] == 1).all()


def test_shards_odd_rows_and_rewrite(spark, odd, tmp_path):
    p = H.plan(odd, shards=4, old_shards=4)
    got = H.assign(odd, p).toPandas()
    assert len(got) == 12 and got["size"].min() == 16
    out = H.reshard(odd, p)
    written = H.rewrite(out, str(tmp_path / "shards"))
    assert out.count() == 12 and spark.read.parquet(str(tmp_path / "shards")).count() == out.filter(out["shard"].isin(written)).count()
    assert H.assign(odd.limit(0), H.plan(odd.limit(0))).count() == 0


def test_equal_texts_stay_whole(spark):
    rows = [(k, "same text " * 40) for k in range(60)] + [(100 + k, f"text number {k} " * 30) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = H.assign(docs, H.plan(docs, shards=5, old_shards=4)).toPandas()
    assert got[got.doc_id < 100].shard.nunique() == 1 and (got.groupby("shard").slot.max() + 1 == got.groupby("shard").slot.nunique()).all()
    spread = got.groupby("shard")["size"].sum()
    assert spread.max() - spread.min() <= 2 * got["size"].max()


def test_rewrite_of_an_existing_layout(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [(k, f"text {k}", k % 4) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    to = {0: 1, 3: 1}  # shards 0 and 3 go to shard 1, so 0 and 3 end empty and 2 is untouched
    have = spark.read.parquet(path)
    old = F.col("shard").alias("old_shard")
    new = F.when(F.col("shard").isin(list(to)), 1).otherwise(F.col("shard")).alias("shard")
    out = have.select("doc_id", "text", new, old, (new != F.col("shard")).alias("shard_moved"))
    kept = sorted((tmp_path / "shards" / "shard=2").glob("*.parquet"))
    assert H.rewrite(out, path) == [0, 1, 3]
    assert sorted((tmp_path / "shards" / "shard=2").glob("*.parquet")) == kept
    got = {(r.doc_id, r.text, r.shard) for r in spark.read.parquet(path).collect()}
    assert got == {(k, t, to.get(s, s)) for k, t, s in rows}
    assert sorted(x for x in os.listdir(path) if not x.endswith("_SUCCESS") and not x.endswith(".crc")) == ["shard=1", "shard=2"]


# ---------------------------------------------------------------- pipeline


def test_stages_keep_user_columns(spark, odd):
    """Values of columns with names of the operators' own come back as they were."""
    import corpus_pipeline

    own = odd.withColumns({c: F.concat(F.lit("u"), F.coalesce(F.col("text"), F.lit("-"))) for c in ("__s", "__id", "__bad", "__p", "__k", "__source", "lang_rejected", "sampled", "probability", "__size")})
    want = {str(r) for r in own.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, own, "/root/testdata/sf0.001")
        assert out.columns == own.columns, name
        assert {str(r) for r in out.collect()} <= want, name
    out = corpus_pipeline.sharding(spark, own.drop("shard"), "/root/testdata/sf0.001")
    assert {str(r) for r in out.select(*own.drop("shard").columns).collect()} == {str(r) for r in own.drop("shard").collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, own.limit(0), "/root/testdata/sf0.001").count() == 0


def test_pipeline_against_its_operators(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lang = {r.doc_id for r in Q.op5_language_zstd(spark, d).filter("not rejected").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r.doc_id in lang]
    cls = classes_of(rows)
    kept = {i for i, c in cls.items() if i == c}
    bad = {r.doc_id for r in Q.op2_spaced_seeds(spark, d).collect()}
    mixed = {r.doc_id for r in K.mix_sources(docs.filter(docs.doc_id.isin(sorted(kept - bad)))).collect() if r.sampled}
    assert set(got.doc_id) == mixed and not got.doc_id.duplicated().any()
    assert {"shard", *docs.columns} <= set(got.columns) and os.path.basename(d) == "sf0.001"


def test_labels_are_few_files(spark):
    from lamina.llm import order_minhash as M

    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = M.components(spark.range(3000).selectExpr("id * 2 AS a", "id * 2 + 1 AS b"))
        assert len(got.inputFiles()) <= 8  # not one for each of 64 partitions
        assert got.filter("label = node - node % 2").count() == 6000
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
