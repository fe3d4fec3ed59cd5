"""Near-duplicates by Order MinHash (operator 10).

A sketch takes the k-mers of words of least hash, each labelled by its occurrence, and keeps their order in the text; texts
that are near in edit distance share sketches. Texts that share one are candidates: in each bucket a text is compared with the
bucket's first one, so the work is linear in the bucket: first that one which it shares most buckets with, then, where they are
still of different classes, the others. A candidate is a near copy if a banded alignment of its words changes at most
1 - ``similarity`` of them. Exact copies are one text from the start.

What the buckets leave is finished exactly, in two ways. Texts that a chain of candidates joins whose alignments change at most
twice as much form a neighbourhood; in it the shared runs of words of all texts of different classes are counted, in blocks, and
those with enough of them are aligned (``_neighbours``). Between neighbourhoods, near copies must share so many runs of two
words that the rarest runs of both meet (``_rest``). So all pairs of different classes are verified or ruled out, without a limit
on rounds or partners.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import byte_codes, cut, drop, encode, fresh, having, mix, pack, prefix_hashes, release, ship, span_hashes, unpack

WORDS, SIMILARITY = 5, 0.8
#: Sketches of a text, and k-mers in a sketch.
SKETCHES, DEPTH = 32, 2
#: Of the exact join: a text shows len / EXTRA runs more than it must; texts a part; texts that share a run from which it is
#: dealt into blocks; pairs that are counted at once; meetings that are listed, and pairs that are given out, at once.
EXTRA, PART_TEXTS, BLOCK, PAIRS, LISTED = 10, 4_096, 2_000, 500_000, 50_000
#: Counts of runs, by which runs are ordered from rare to common, are kept by hash in at most so many bins, four for each
#: document. The order decides how much is compared, never the result.
MOST_BINS, RANGES = 1 << 24, 64
#: Of a neighbourhood: texts and words of a block, of which two are compared at once; runs that are counted at once.
NEAR_TEXTS, NEAR_WORDS, COLUMNS = 300, 500_000, 4_096

_CODES = byte_codes(3)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(data: bytes) -> np.ndarray:
    """Hashes of the words in order."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    return mix(span_hashes(prefix_hashes(_CODES[raw]), begin, end)) if len(begin) else np.zeros(0, np.uint64)


def kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of k words in order; of all words if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    prefix, n = prefix_hashes(words), max(1, len(words) - k + 1)
    at = np.arange(n)
    return span_hashes(prefix, at, np.minimum(at + k, len(words)))


def labelled(h: np.ndarray) -> np.ndarray:
    """Each hash with the number of its occurrence in it, so that repeats differ."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    seen = np.empty(len(h), np.uint64)
    seen[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate([first, [len(h)]])))
    return mix(h + seen * np.uint64(0xD6E8FEB86659FD93))


def sketch(words: np.ndarray, sketches: int = SKETCHES, depth: int = DEPTH) -> np.ndarray:
    """The Order MinHash sketches of a text's words; none for a text without words."""
    h = kmers(words)
    if not len(h):
        return np.zeros(0, np.int64)
    label = labelled(h)
    out = np.empty(sketches, np.uint64)
    d = min(depth, len(h))
    step = max(1, 1_000_000 // len(h))  # long texts a few sketches at a time
    for at in range(0, sketches, step):
        value = mix(label[None, :] ^ _SEEDS[at : min(at + step, sketches), None])
        least = np.sort(np.argpartition(value, d - 1, axis=1)[:, :d] if d < len(h) else np.broadcast_to(np.arange(len(h)), value.shape), axis=1)
        acc = _SEEDS[at : min(at + step, sketches)].copy()
        for j in range(d):  # in text order
            acc = mix(acc * np.uint64(0xBF58476D1CE4E5B9) + label[least[:, j]])
        out[at : at + step] = acc
    return out.view(np.int64)


def banded_distance(a: list, b: list, most: int) -> int:
    """Word edit distance if at most ``most``, else most + 1: in a narrow band first, which soon fails or is enough, then in one that holds any such alignment."""
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b, k = a[: len(a) - end], b[: len(b) - end], 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b or abs(len(a) - len(b)) > most:
        return min(max(len(a), len(b)), most + 1)
    for band in (max(16, abs(len(a) - len(b))), most):
        band = min(band, most)
        d = _band(a, b, band)
        if d <= band or band == most:
            return min(d, most + 1)
    return most + 1


def _band(x: list, y: list, k: int) -> int:
    """Distance along paths within k of the diagonal, exact if it is at most k, else k + 1; bit-parallel, a column of the band an integer.

    Bit b of column j stands for row j - k + b. Steps down a column are +1 (up), -1 (down) or 0; rows above the first hold the
    column's number, so their steps are 0, and the row below the band counts as one more than its neighbour. The end lies on a
    diagonal, that is on one bit: the distance is what that bit's diagonal steps add up to.
    """
    if abs(len(x) - len(y)) > k:
        return k + 1
    where: dict = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    mask, low = (1 << 2 * k + 1) - 1, 1 << 2 * k
    up, down = mask >> k << k, 0
    end, skip = k + len(x) - len(y), max(0, len(y) - len(x))
    distance = abs(len(x) - len(y))
    for j, w in enumerate(y, 1):
        hit = where.get(w, 0)
        same = (hit >> j - k - 1 if j > k else hit << k + 1 - j) & mask
        zero = ((((same & up) + up) ^ up) | same | down) & mask
        right = down | (mask ^ (zero | up))
        left = zero & up
        if j > skip and not zero >> end & 1:
            distance += 1
            if distance > k:  # it never falls again
                return k + 1
        below = zero >> 1
        up = left | (mask ^ (below | right)) | low
        down = below & right & ~low
    return distance


def nearness(a: bytes, b: bytes, similarity: float = SIMILARITY, k: int = WORDS, loose: bool = True) -> int:
    """2 for near copies: edits of words, over the words of the longer, at most 1 - similarity; 1 for up to twice as many, if asked for; else 0."""
    x, y = _WORD.findall(a), _WORD.findall(b)
    n, most = max(len(x), len(y)), int((1 - similarity) * max(len(x), len(y)) + 1e-9)
    if len(x) < k or len(y) < k:
        return 2 if x == y else 0
    top = 2 * most if loose else most
    if min(len(x), len(y)) < n - top or (Counter(x) & Counter(y)).total() < n - top:  # words that no alignment can keep
        return 0
    d = banded_distance(x, y, top)
    return 2 if d <= most else 1 if d <= top else 0


def similar(a: bytes, b: bytes, similarity: float = SIMILARITY, k: int = WORDS) -> bool:
    """Whether two texts are near copies."""
    return nearness(a, b, similarity, k, loose=False) == 2


def _texts(docs: DataFrame) -> DataFrame:
    """Rows with the text's identity: two hashes and its length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).alias("k2"), F.length(text).alias("k3"))


TEXT_KEY = ["k1", "k2", "k3"]


def _sketched(texts: DataFrame, bins: int, width: int) -> DataFrame:
    """For each row its sketches and number of words; for each task its counts of runs by bin, a row for each range of bins."""
    kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("k3", pa.int32()), ("doc_id", pa.int64()), ("words", pa.int32()), ("sketches", pa.list_(pa.int64())), ("range", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(bins, np.uint32)
        for b in batches:
            got, size = [], []
            with np.errstate(over="ignore"):
                for t in b.column("text").to_pylist():
                    w = words_of(encode(t))
                    got.append(sketch(w))
                    size.append(len(w))
                    bin_, times = np.unique(kmers(w, width) % np.uint64(bins), return_counts=True)
                    counts[bin_.astype(np.int64)] += times.astype(np.uint32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64)))
            none = [pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(x).cast(kinds.field(x).type) for x in ("k1", "k2", "k3", "doc_id")] + [pa.array(size, pa.int32()), lists, *none], schema=kinds)
        if counts.any():
            step = bins // RANGES
            rows = [{"range": r, "counts": pack(n=counts[r * step : (r + 1) * step])} for r in range(RANGES)]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return texts.select(*TEXT_KEY, "doc_id", "text").mapInArrow(run, "k1 long, k2 long, k3 int, doc_id long, words int, sketches array<long>, range int, counts binary")


def _frequency(sketched: DataFrame, bins: int) -> np.ndarray:
    """How many runs of the table fall into each bin: summed range by range, a number for each bin reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r, block in zip(b.column("range").to_pylist(), b.column("counts").to_pylist(), strict=True):
                n = unpack(block)["n"].astype(np.int64)
                total[r] = total[r] + n if r in total else n
        for r, n in total.items():
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "counts": pa.array([pack(n=n)], pa.binary())})

    summed = sketched.filter("counts is not null").select("range", "counts").repartition(RANGES, "range").mapInArrow(add, "range int, counts binary")
    out, step = np.zeros(bins, np.int64), bins // RANGES
    for r in summed.collect():  # RANGES rows, MOST_BINS numbers in all
        out[r["range"] * step : (r["range"] + 1) * step] = unpack(bytes(r["counts"]))["n"]
    return out


def _lengths_fit(a: str, b: str, similarity: float):
    """Texts of these numbers of words can be near copies."""
    longer = F.greatest(a, b)
    return F.least(a, b) >= longer - F.floor(longer * (1 - similarity) + 1e-9)


def _members(groups: DataFrame) -> DataFrame:
    """(bucket, node, words, rep, rep_words): the texts of each bucket that several share, with its first text; kept."""
    members = groups.select("node", "words", F.explode("sketches").alias("bucket"))
    first = members.groupBy("bucket").agg(F.min(F.struct("node", "words")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = cut(first.select("bucket", F.col("first.node").alias("rep"), F.col("first.words").alias("rep_words")))
    out = cut(members.join(first, "bucket"))
    drop(first)
    return out


def _candidates(members: DataFrame, similarity: float) -> DataFrame:
    """(node, rep, shared): the first text of each bucket that a text is in, and in how many of its buckets that is the first; kept."""
    met = members.filter((F.col("node") != F.col("rep")) & _lengths_fit("words", "rep_words", similarity))
    return cut(met.groupBy("node", "rep").agg(F.count(F.lit(1)).alias("shared")))


def _apart(pairs: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose ends are of different classes, with those as la and lb."""
    ends = labels.withColumnRenamed("label", "x")
    out = pairs.join(ends.withColumnsRenamed({"node": a, "x": "la"}), a, "left").join(ends.withColumnsRenamed({"node": b, "x": "lb"}), b, "left")
    return out.withColumns({"la": F.coalesce("la", a), "lb": F.coalesce("lb", b)}).filter("la <> lb")


def _least_overlap(n: np.ndarray, similarity: float, width: int) -> np.ndarray:
    """Runs of ``width`` words that a text of n words shares at least with any near copy of n words or more."""
    f = lambda m: m - (width - 1) - width * ((1 - similarity) * m + 1e-9).astype(np.int64)
    return np.min([f(n + k) for k in range(int((width + 1) / (1 - width * (1 - similarity))) + 3)], axis=0)


def _extra(n: np.ndarray, similarity: float, width: int) -> np.ndarray:
    """Runs that a text of n words shows beyond the fewest by which it meets its near copies."""
    return np.minimum(n // EXTRA, _least_overlap(n, similarity, width) - 1)


def _width(similarity: float) -> int:
    """Two words where near copies of any length share a run of two; else one."""
    n = np.arange(WORDS, 200)
    return 2 if similarity > 0.5 and _least_overlap(n, similarity, 2).min() >= 1 else 1


def _runs(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``width`` words of a text as a set, each told apart by its occurrence, and the runs' plain hashes."""
    h = kmers(words, width)
    return labelled(h), h


def _neighbours(texts: DataFrame, nodes: DataFrame, labels: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different classes of a neighbourhood that join all of its texts that are near copies; kept.

    A neighbourhood is dealt into blocks by a hash of the text's node, and each pair of blocks is one group; what is held of it
    is bounded by NEAR_TEXTS and NEAR_WORDS. Shared runs of all its pairs are counted by a product of matrices; those with enough
    of them are aligned, unless links of the group join them already. Only links come out.
    """
    width = _width(similarity)
    named = nodes.select("node", "words").join(hubs.withColumnRenamed("label", "hub"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("words").alias("w")).filter("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("n") / NEAR_TEXTS), F.ceil(F.col("w") / NEAR_WORDS)).cast("int")
    several = cut(several.select("hub", blocks.alias("blocks")), short=True)
    named = cut(named.join(several, "hub").filter(F.col("words") >= WORDS).select("node", "hub", "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                got = [words_of(encode(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(got, pa.binary())], names=["node", "words"])

    held = having(texts, named.select("node").distinct(), "node").select("node", "text").mapInArrow(hashed, "node long, words binary").join(named, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = held.select("hub", "node", "label", "words", "mine", other).select("hub", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "label", "words")

    def compare(table: pa.Table) -> pa.Table:
        node, label, mine = (table[c].to_numpy() for c in ("node", "label", "mine"))
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["words"]]
        return pa.table(dict(zip(("a", "b"), _links(node, label, mine, words, similarity, width), strict=True)))

    out = cut(dealt.groupBy("hub", "lo", "hi").applyInArrow(compare, "a long, b long"))
    drop(several, named)
    return out


def _links(node: np.ndarray, label: np.ndarray, block: np.ndarray, words: list[np.ndarray], similarity: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the texts of one block or of two that join all near copies of different classes; texts are hashes of words."""
    size = np.array([len(w) for w in words])
    kinds, cls, counts = np.unique(label, return_inverse=True, return_counts=True)
    if block.min() == block.max():  # all but the largest class with all
        rows, cols = np.flatnonzero(cls != counts.argmax()), np.arange(len(node))
    else:
        rows, cols = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    with np.errstate(over="ignore"):
        sets = [_runs(w, width)[0] for w in words]
    owner = np.repeat(np.arange(len(node)), [len(x) for x in sets])
    _, run, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # of the runs that several have
    several = times[run] > 1
    run, owner = number[run[several]], owner[several]
    order = np.argsort(run, kind="stable")
    run, owner = run[order], owner[order]
    shared = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, int(run[-1]) + 1 if len(run) else 0, COLUMNS):
        lo, hi = np.searchsorted(run, (at, at + COLUMNS))
        have = np.zeros((len(node), COLUMNS), np.float32)
        have[owner[lo:hi], run[lo:hi] - at] = 1
        shared += have[rows] @ have[cols].T
    longer = np.maximum(size[rows][:, None], size[cols][None, :])
    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    enough = (shared >= longer - (width - 1) - width * most) & (np.minimum(size[rows][:, None], size[cols][None, :]) >= longer - most) & (cls[rows][:, None] != cls[cols][None, :])
    i, j = np.nonzero(enough)
    order = np.argsort(-shared[i, j] / longer[i, j], kind="stable")  # the likeliest first
    parent, ids = list(range(len(kinds))), {}
    _, word = np.unique(np.concatenate(words), return_inverse=True)
    begin, number = np.concatenate([[0], np.cumsum(size)]), list(range(int(word.max()) + 1 if len(word) else 0))  # one object for each word
    out: tuple[list[int], list[int]] = ([], [])

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for x, y in zip(rows[i[order]].tolist(), cols[j[order]].tolist(), strict=True):
        a, b = top(int(cls[x])), top(int(cls[y]))
        if a == b:
            continue
        for t in (x, y):
            if t not in ids:
                w = [number[k] for k in word[begin[t] : begin[t + 1]].tolist()]
                ids[t] = (w, Counter(w))
        (p, pc), (q, qc) = ids[x], ids[y]
        n = max(len(p), len(q))
        allowed = int((1 - similarity) * n + 1e-9)
        if (pc & qc).total() >= n - allowed and banded_distance(p, q, allowed) <= allowed:
            parent[max(a, b)] = min(a, b)
            out[0].append(int(node[x]))
            out[1].append(int(node[y]))
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def _rest(texts: DataFrame, nodes: DataFrame, labels: DataFrame, frequency: np.ndarray, similarity: float) -> DataFrame:
    """All pairs (a, b, shared) of different ``labels`` (neighbourhoods) that may be near copies, by an exact join on rare runs of words.

    An edit breaks at most ``width`` runs, so near copies share at least T of theirs. In any one order of all runs, here from rare to
    common, the first len - T + 1 + e runs of both then have 1 + e in common. Pairs that have fewer, whose lengths differ too
    much, or that are of one neighbourhood are left out; the others are returned. Runs that very many texts share are dealt into blocks,
    and each pair of blocks meets.
    """
    spark, n, width, block_texts = texts.sparkSession, nodes.count(), _width(similarity), BLOCK
    parts = max(1, -(-n // PART_TEXTS))  # few: a pair is counted once in each part where its runs lie
    usual = int(frequency.mean()) if len(frequency) else 0
    known = spark.sparkContext.broadcast(frequency)  # MOST_BINS numbers
    held = nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    held = texts.join(held, "node")

    def first_runs(words: int, have: int) -> int:
        n = np.array([words])
        return have - int(_least_overlap(n, similarity, width)[0]) + 1 + int(_extra(n, similarity, width)[0])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                node, label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label"))
                words, all_, row, side = np.zeros(b.num_rows, np.int32), [], [], []
                with np.errstate(over="ignore"):
                    for k, t in enumerate(b.column("text").to_pylist()):
                        w = words_of(encode(t))
                        if len(w) < WORDS:
                            continue  # equal words only: all its sketches are equal
                        x, plain = _runs(w, width)
                        words[k] = len(w)
                        often = times[(plain % np.uint64(len(times))).astype(np.int64)]
                        order = np.lexsort((x, often))[: first_runs(len(w), len(x))]
                        x, often = x[order], often[order] - usual
                        heavy = often > block_texts
                        for j in np.flatnonzero(heavy).tolist():
                            blocks = -(-int(often[j]) // block_texts)
                            mine = int(mix(np.array([node[k]]).view(np.uint64))[0] % np.uint64(blocks))
                            other = np.arange(blocks, dtype=np.uint64)
                            low, high = np.minimum(other, np.uint64(mine)), np.maximum(other, np.uint64(mine))
                            all_.append(mix(x[j] + (low * np.uint64(blocks) + high + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
                            row.append(np.full(blocks, k, np.uint16))
                            side.append(np.where(low == high, 0, np.where(low == mine, 1, 2)).astype(np.uint8))
                        x = x[~heavy]
                        all_.append(x)
                        row.append(np.full(len(x), k, np.uint16))
                        side.append(np.zeros(len(x), np.uint8))
                if not all_:
                    continue
                x, row_, side_ = np.concatenate(all_), np.concatenate(row), np.concatenate(side)
                part = (x % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((x >> np.uint64(32), part))
                x, row_, part, side_ = (x[order] >> np.uint64(32)).astype(np.uint32), row_[order], part[order], side_[order]
                cut_at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
                out: tuple[list, list] = ([], [])
                for lo, hi in zip(cut_at, cut_at[1:], strict=False):
                    used, mine = np.unique(row_[lo:hi], return_inverse=True)
                    out[0].append(int(part[lo]))
                    out[1].append(pack(x=x[lo:hi], row=mine.astype(np.uint16), side=side_[lo:hi], node=node[used], label=label[used], words=words[used]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["part", "block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for b in batches:
            for p, block in zip(b.column("part").to_pylist(), b.column("block").to_pylist(), strict=True):
                blocks.setdefault(p, []).append(block)
        while blocks:
            for a, b, shared, need in _meetings(blocks.popitem()[1], similarity):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, shared, need)], names=["a", "b", "shared", "need"])

    dealt = held.select("node", "label", "text").mapInArrow(deal, "part int, block binary").repartition(parts, "part")
    met = dealt.mapInArrow(meet, "a long, b long, shared long, need long")
    return met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b", "shared")


def _meetings(blocks: list[bytes], similarity: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, runs shared, runs needed) of the pairs of different classes that share a run in these blocks, at most LISTED at a time.

    Two tasks of an executor do this at once beside its JVM, so what is held is kept small: a part's runs, PAIRS counted pairs
    and about as many that wait to be counted, both as short as they can be, and the arrays of LISTED meetings.
    """
    cols: dict[str, list[np.ndarray]] = {k: [] for k in ("x", "row", "side", "node", "label", "words")}
    base = 0
    while blocks:
        got = unpack(blocks.pop())
        got["row"] = got["row"].astype(np.int32) + np.int32(base)
        base += len(got["node"])
        for k, v in cols.items():
            v.append(got[k])
    x, row, side, node, label, words = (np.concatenate(cols.pop(k)) for k in list(cols))
    order = np.argsort(x, kind="stable")
    x, row, side = x[order], row[order], side[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    several = np.minimum.reduceat(label[row], first) != np.maximum.reduceat(label[row], first)
    keep = np.repeat(several, np.diff(np.concatenate([first, [len(x)]])))
    x, row, side = x[keep], row[keep], side[keep]
    del order, first, several, keep
    if not len(x):
        return
    # Texts of a class stand together in their group, so each meets just those of the classes after its own.
    of = label[row]
    order = np.lexsort((of, x))
    x, row, side, of = x[order], row[order], side[order], of[order]
    new_group = np.concatenate([x[1:] != x[:-1], [True]])
    new_class = new_group | np.concatenate([of[1:] != of[:-1], [True]])
    ends = lambda last: np.repeat((e := np.flatnonzero(last) + 1).astype(np.int32), np.diff(e, prepend=0))  # noqa: E731  for each row where its group ends
    class_end = ends(new_class)
    meets = ends(new_group) - class_end
    total = np.cumsum(meets, dtype=np.int64)
    del x, of, order, new_group, new_class
    words = words.astype(np.int64)
    least, extra = words - ((1 - similarity) * words + 1e-9).astype(np.int64), _extra(words, similarity, _width(similarity))

    def rows(code: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for at in range(0, len(code), LISTED):
            i, j = code[at : at + LISTED] // base, code[at : at + LISTED] % base
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), times[at : at + LISTED].astype(np.int64), 1 + np.minimum(extra[i], extra[j])

    def listed() -> Iterator[np.ndarray]:
        """The pairs that meet, LISTED meetings at a time, each as one sorted array."""
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LISTED, "right")))
            n = meets[lo:hi]
            mine = np.repeat(np.arange(lo, hi), n)
            other = class_end[mine] + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
            i, j = row[mine], row[other]
            longer = np.where(words[i] >= words[j], i, j)
            ok = (np.minimum(words[i], words[j]) >= least[longer]) & ((side[mine] == 0) | (side[mine] != side[other]))
            i, j, lo = i[ok], j[ok], hi
            yield np.minimum(i, j).astype(np.int64) * base + np.maximum(i, j)

    code, times, waiting = np.zeros(0, np.int64), np.zeros(0, np.int32), []
    for new in listed():
        waiting.append(new)
        if sum(map(len, waiting)) > PAIRS:
            code, times = _counted(code, times, waiting)
            if len(code) > PAIRS:
                yield from rows(code, times)
                code, times = code[:0].copy(), times[:0].copy()
    code, times = _counted(code, times, waiting)
    yield from rows(code, times)


def _counted(code: np.ndarray, times: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, sorted, and their counts, after those of ``waiting`` are counted once each; ``waiting`` is empty then."""
    new = np.concatenate([code[:0], *waiting])
    waiting.clear()
    new.sort()
    first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])[: len(new)])
    n, new = np.diff(first, append=len(new)).astype(np.int32), new[first]
    at = np.searchsorted(code, new)
    known = code[np.minimum(at, len(code) - 1)] == new if len(code) else np.zeros(len(new), bool)
    times[at[known]] += n[known]  # codes of ``new`` differ
    at, new, n = at[~known], new[~known], n[~known]
    return np.insert(code, at, new), np.insert(times, at, n)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, loose: bool = False) -> DataFrame:
    """The pairs (a, b, near) that are near copies, with ``loose`` also those of up to twice as many edits, not near; kept.

    Only texts that some pair names are moved; they are a table, so that each join has plain exchanges, whose large partitions Spark splits.
    """
    pairs = cut(pairs.select("a", "b"), short=True)
    if pairs.isEmpty():
        out = cut(pairs.withColumn("near", F.lit(True)))
        drop(pairs)
        return out
    named = cut(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), short=True)
    wanted = cut(having(texts, named, "node"))
    both = pairs.join(wanted.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(wanted.withColumnsRenamed({"node": "b", "text": "tb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([nearness(encode(x.as_py()), encode(y.as_py()), similarity, loose=loose) for x, y in zip(b.column("ta"), b.column("tb"), strict=True)], np.int8)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(got == 2)], names=["a", "b", "near"]).filter(pa.array(got > 0))

    out = cut(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, near boolean").distinct(), short=True)
    drop(pairs, named, wanted)
    return out


def _settled(pairs: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Labels after all ``pairs`` (a, b, shared): first the likeliest of each two classes, then what those left apart. ``pairs`` and ``labels`` go."""
    if pairs.isEmpty():
        drop(pairs)
        return labels
    apart = _apart(pairs, labels, "a", "b")
    top = apart.groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.max(F.struct("shared", "a", "b")).alias("top")).select("top.a", "top.b")
    labels = joined(labels, _verified(top, texts, similarity))
    labels = joined(labels, _verified(_apart(pairs, labels, "a", "b"), texts, similarity))
    drop(pairs)
    return labels


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links reach. Labels spread to neighbours and jump to their label's label; each step is a table of its own, and the one before goes."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), short=True)
    step = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("was", F.col("node")), short=True)
    while True:
        labels = step.select("node", "label")
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("least"), "label")
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        last, step = step, cut(least.join(jump, "least", "left").select("node", F.least("least", F.coalesce("far", "least")).alias("label"), F.col("label").alias("was")), short=True)
        drop(last)
        if step.filter("label <> was").isEmpty():
            drop(both)
            out = step.select("node", "label")
            out._lamina_table = step._lamina_table
            return out


def joined(labels: DataFrame, links: DataFrame, keep: bool = False) -> DataFrame:
    """Labels after more links: components of the labels that links join, which are few, then each node's label's label. ``labels`` go, and ``links`` unless to ``keep``."""
    if links.isEmpty():
        drop(None if keep else links)
        return labels
    between = cut(_apart(links, labels, "a", "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), short=True)
    merged = components(between)
    new = merged.join(labels.select("node"), "node", "left_anti")  # nodes without a label until now
    moved = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = cut(moved.unionByName(new), short=True)
    drop(between, merged, labels, None if keep else links)
    release(out.sparkSession)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_of) for each row of ``docs`` that has a doc_id.

    copy_of is the least doc_id with the same text, class_id the least doc_id of all texts that links join. Null texts count as
    empty; texts without words are joined only as exact copies, those of fewer than five words only if their words are equal.
    Rows that share a doc_id are one document: their texts share a class. Rows without a doc_id are left out. Very long texts
    are compared whole. An empty table gives an empty table. Columns other than doc_id and text are not read, whatever their names.
    """
    spark = ship(docs.sparkSession)
    rows = _texts(docs).filter("doc_id is not null")
    bins = min(MOST_BINS, max(RANGES, 1 << (4 * max(1, docs.count()) - 1).bit_length()))
    sketched = cut(_sketched(rows, bins, _width(similarity)))
    frequency = _frequency(sketched, bins)
    groups = cut(sketched.filter("counts is null").groupBy(*TEXT_KEY).agg(F.min("doc_id").alias("node"), F.first("words").alias("words"), F.first("sketches").alias("sketches")))
    drop(sketched)
    nodes = groups.filter("words > 0")
    texts = rows.select(F.col("doc_id").alias("node"), "text")
    members = _members(nodes)
    found = _candidates(members, similarity)
    best = cut(found.groupBy("node").agg(F.max(F.struct("shared", (-F.col("rep")).alias("back"))).alias("best")).select("node", (-F.col("best.back")).alias("rep")), short=True)
    one = _verified(best.select(F.col("node").alias("a"), F.col("rep").alias("b")), texts, similarity, loose=True)
    labels = components(one.filter("near"))
    others = found.join(best.withColumnRenamed("rep", "tried"), "node").filter("rep <> tried").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    two = _verified(_apart(others, labels, "a", "b"), texts, similarity, loose=True)
    drop(found, best, members)
    labels = joined(labels, two.filter("near"), keep=True)
    hubs = components(one.unionByName(two))
    drop(one, two)
    release(spark)
    labels = joined(labels, _neighbours(texts, nodes, labels, hubs, similarity))
    labels = _settled(cut(_rest(texts, nodes, hubs, frequency, similarity)), labels, texts, similarity)
    drop(hubs)
    named = rows.select("doc_id", *TEXT_KEY).join(groups.select(*TEXT_KEY, "node"), TEXT_KEY)
    return named.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"), F.col("node").alias("copy_of"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, that of the least doc_id; all columns stay as they are, whatever their names.

    Rows without a doc_id stay. Of rows that repeat a kept doc_id the one of least text stays. Null and empty texts are copies
    of each other. An empty table gives an empty table.
    """
    classes = cut(near_duplicates(docs, similarity))
    gone = classes.filter("doc_id <> class_id").select("doc_id").distinct()
    again = classes.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    rank = fresh(docs, "__k")[0]
    few = kept.join(again, "doc_id")
    one = few.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter(F.col(rank) == 1).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
