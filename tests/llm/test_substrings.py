import hashlib
import random
import re

import numpy as np

from lamina.llm import recompress_dedup as W
from lamina.llm import repeats as R
from lamina.llm import suffix_dedup as S


def brute_bytes(rows, w=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1 if d is not None else 0):
            first[b[i : i + w]] = min(first.get(b[i : i + w], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1 if d is not None else 0):
            if first[b[i : i + w]] < d:
                gone[i : i + w] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d or -1, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, w=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), x in zip(rows, words, strict=True):
        for i in range(len(x) - w + 1 if d is not None else 0):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), x in zip(rows, words, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - w + 1 if d is not None else 0):
            if first[tuple(x[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        kept = " ".join(y for y, g in zip(x, gone, strict=True) if not g)
        out.append((d or -1, len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def both(df):
    key = lambda r: (r[0] or -1, *r[1:])
    return sorted(key(r) for r in S.dedup_substrings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), sorted(key(r) for r in W.dedup_words(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_random_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    base, rows = [text(rng.randint(20, 300), "ab ") for _ in range(30)], []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            a = rng.randrange(len(x))
            parts += [x[a : a + rng.randint(10, 120)], text(rng.randint(0, 20), "abc é\n")]
        rows.append((rng.randrange(1, 100) if rng.random() < 0.95 else None, "".join(parts) if rng.random() < 0.97 else None))
    rows += rows[:10] + [(500, "a" * 400), (501, "a" * 300), (502, "x " * 60), (503, "x " * 40 + "y"), (504, "")]
    rows += [(600 + k, " ".join(rng.choice("pqr") for _ in range(200))) for k in range(6)]
    got = both(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == (brute_bytes(rows), brute_words(rows))


def test_documents_against_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert both(docs) == (brute_bytes(rows), brute_words(rows))


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert both(odd) == (brute_bytes(rows), brute_words(rows))
    assert both(odd.limit(0)) == ([], [])


def test_every_window_has_an_anchor():
    rng = random.Random(7)
    for scheme, make in ((S.ByteWindows(), lambda: "".join(rng.choice("ab") for _ in range(300))), (W.WordWindows(), lambda: " ".join(rng.choice("ab") for _ in range(150)))):
        text = make()
        with np.errstate(over="ignore"):
            pos, _ = scheme.anchors(scheme.units(text))
        n = len(text) if isinstance(scheme, S.ByteWindows) else len(text.split())
        for s in range(n - scheme.window + 1):
            assert ((pos - s >= scheme.lo) & (pos - s <= scheme.hi)).any()


def test_classes_sort_and_survive_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    codes = rng.integers(1, 3, (400, 20)).astype(np.uint16)
    row, col, seg = rng.integers(0, 400, 900), rng.integers(0, 14, 900), rng.integers(0, 5, 900)
    want = {}
    ids = [want.setdefault((int(s), *codes[r, c : c + 6].tolist()), len(want)) for r, c, s in zip(row, col, seg, strict=True)]
    got = R.classes({}, codes, row, col, 6, seg)
    assert len(set(zip(ids, got.tolist(), strict=True))) == len(want) == len(set(got.tolist()))
    monkeypatch.setattr(R, "BASES", (0,))  # a base that makes all spans collide but for their last unit
    got = R.classes({}, codes, row, col, 6, seg)
    assert len(set(zip(ids, got.tolist(), strict=True))) == len(want) == len(set(got.tolist()))


def test_recompression_is_local():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = set(zip(*W.recompress(np.concatenate([rng.integers(1, 1 << 60, 17).astype(np.uint64), a])), strict=True))
        two = set(zip(*W.recompress(np.concatenate([rng.integers(1, 1 << 60, 30).astype(np.uint64), a])), strict=True))
    inner = {(n, s - 17) for n, s in one if 17 + 3 <= s < 17 + 54}
    assert inner == {(n, s - 30) for n, s in two if 30 + 3 <= s < 30 + 54}


def test_a_line_that_all_documents_repeat_costs_its_places(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    scheme, n, times = S.ByteWindows(), 60, 900
    texts = [f"{k} begins here. " + "Is on the. " * times + f"ends {k * 7}" for k in range(n)]
    with np.errstate(over="ignore"):
        found = [scheme.anchors(scheme.units(t)) for t in texts]
    hits = [[{"pos": int(p), "key": int(k & ((np.uint64(1) << R.KEY_BITS) - np.uint64(1)))} for p, k in zip(*f, strict=True)] for f in found]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1, n + 1)), "text": texts, "n": [len(t) for t in texts], "crc": [0] * n, "hits": hits})
    blocks = R.gathered(scheme, batch, 1)
    got = R.unpack(blocks[0])
    assert len(got["doc"]) == sum(map(len, hits)) > 50_000 and len(got["size"]) < 2_000

    def kept():
        table, out = R.decided(scheme, [blocks[0]]).to_pydict(), {}
        for d, p, bits in zip(table["doc_id"], table["pos"], table["bits"], strict=True):
            out.setdefault(d, []).append((p, bits))
        gone = [R.covered(scheme, len(t), *(np.array(x, k) for x, k in zip(zip(*out.get(d, [(0, 0)]), strict=True), (np.int64, np.uint64), strict=True))) for d, t in enumerate(texts, 1)]
        return [(d, len(t), int(g.sum())) for d, (t, g) in enumerate(zip(texts, gone, strict=True), 1)]

    tracemalloc.start()
    first = kept()
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert first == [x[:3] for x in brute_bytes(list(enumerate(texts, 1)))]
    for chunk, spans in ((5, 20), (100_000, 30)):  # keys with more contexts than are compared at once, and few windows at once
        monkeypatch.setattr(R, "CHUNK", chunk)
        monkeypatch.setattr(R, "SPANS", spans)
        assert kept() == first
