"""Finding every window that also occurs in a document with a smaller id, for substring deduplication (operators 4 and 8).

Documents that copy one with a smaller id repeat all they have and take no further part. A scheme picks anchors: positions that any window contains at least one of, at the same place in each of its occurrences.
1. Anchors go by key to parts; those of one document only are dropped. They cost some seven bytes each.
2. The remaining anchors fetch their context, the units that windows around them can cover, and meet again by key.
3. Equal contexts go as one, with the places that have it: so a line that all documents share costs little more than its
   places. Among the different contexts of a key the windows at each offset are sorted as suffixes, compared by prefix hashes and
   binary search and checked unit by unit. Work is linear in the contexts; no pairs are formed.
4. Each document gets the offsets of its repeated windows.
A part is one key range; their number follows spark.sql.shuffle.partitions, so what a task holds does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import BASES, mix, pack, partitions, ship, unpack

#: Anchors that a map task holds before it sends them on.
FLUSH = 2_000_000
#: Different contexts, and windows in them, that are compared at once.
CHUNK, SPANS = 20_000, 200_000
KEY_BITS = np.uint64(40)


class Scheme:
    """window: units in a window; a window may begin lo to hi units before an anchor it contains."""

    window: int
    lo: int
    hi: int

    @property
    def right(self) -> int:
        return self.window - self.lo

    def units(self, text: str):
        """The text as units; what the other methods take."""
        raise NotImplementedError

    def anchors(self, units) -> tuple[np.ndarray, np.ndarray]:
        """Positions, ascending, and 64-bit keys."""
        raise NotImplementedError

    def context(self, units, pos: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """For each anchor its context as bytes, and how many units of it lie before and from the anchor on."""
        raise NotImplementedError

    def codes(self, contexts: list[bytes], before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """A row of hi + right positive codes for each context, 0 where the document has no unit; equal units, equal codes."""
        raise NotImplementedError


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of the given width, by doubling."""
    if len(a) < width:
        return a[:0]
    have, w = a, 1
    while 2 * w <= width:
        have, w = op(have[:-w], have[w:]), 2 * w
    return have if w == width else op(have[: len(a) - width + 1], have[width - w : width - w + len(a) - width + 1])


class Hashed:
    """Rows of codes with their prefix hashes, column by column; made once for all that is compared in them."""

    def __init__(self, codes: np.ndarray, base: int):
        n, width = codes.shape
        self.codes, self.n, self.width = codes, n, width
        with np.errstate(over="ignore"):
            b = np.uint64(base)
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(width, b)]), dtype=np.uint64)
            spread = mix(np.arange(int(codes.max()) + 1 if codes.size else 1, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
            columns = np.ascontiguousarray(codes.T)
            h = np.zeros((width + 1, n), np.uint64)
            for j in range(width):
                np.multiply(h[j], b, out=h[j + 1])
                h[j + 1] += spread[columns[j]]
        self.flat, self.units = h.ravel(), columns.ravel()


class _Suffixes:
    """Spans of equal length in the rows of codes, compared by prefix hashes."""

    def __init__(self, hashed: Hashed, row: np.ndarray, col: np.ndarray, length: int):
        self.codes, self.row, self.col, self.length = hashed.codes, row, col, length
        self.flat, self.units, self.n, self.power = hashed.flat, hashed.units, hashed.n, hashed.power
        self.at = col * hashed.n + row  # where a span begins, column by column
        self.begin = self.flat[self.at]
        with np.errstate(over="ignore"):
            self.whole = self.flat[self.at + length * hashed.n] - self.begin * self.power[length]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension, at most the span: the whole first, then binary search over prefix hashes."""
        out = np.full(len(a), self.length, np.int64)
        apart = np.flatnonzero(self.whole[a] != self.whole[b])
        if len(apart):
            x, y = a[apart], b[apart]
            ax, ay, hx, hy, n = self.at[x], self.at[y], self.begin[x], self.begin[y], self.n
            lo, hi = np.zeros(len(apart), np.int64), np.full(len(apart), self.length - 1, np.int64)
            for _ in range(int(self.length - 1).bit_length()):
                mid = (lo + hi + 1) >> 1
                p, step = self.power[mid], mid * n
                same = self.flat[ax + step] - hx * p == self.flat[ay + step] - hy * p
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            out[apart] = lo
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether a sorts before b; ``ties`` where they are equal."""
        k = self.common(a, b)
        full, step = k >= self.length, np.minimum(k, self.length - 1) * self.n
        return np.where(full, ties, self.units[self.at[a] + step] < self.units[self.at[b] + step])

    def verified(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether all these pairs, equal by hash, are equal unit by unit."""
        step = np.arange(self.length)
        for at in range(0, len(a), 50_000):
            x, y = a[at : at + 50_000], b[at : at + 50_000]
            if (self.codes[self.row[x][:, None], self.col[x][:, None] + step] != self.codes[self.row[y][:, None], self.col[y][:, None] + step]).any():
                return False
        return True


def classes(hashed: dict[int, Hashed], codes: np.ndarray, row: np.ndarray, col: np.ndarray, length: int, segment: np.ndarray) -> np.ndarray:
    """A number for each span, equal for equal spans of one segment: a merge sort of all segments at once, in numpy steps.

    Runs double; each element finds its rank in the neighbouring run by binary search. Equal neighbours in the order are
    checked unit by unit; after a collision of hashes all is done again with another base. ``hashed`` keeps the hashes by base.
    """
    n = len(row)
    if not n:
        return np.zeros(0, np.int64)
    start_order = np.argsort(segment, kind="stable")
    seg = segment[start_order]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    seg_lo, seg_hi = np.repeat(first, size), np.repeat(first + size, size)
    at = np.arange(n)
    local = at - seg_lo
    bases = [*BASES, *(int(x) | 1 for x in np.random.default_rng(5).integers(1 << 62, 1 << 63, 6))]
    for base in bases:
        if base not in hashed:
            hashed[base] = Hashed(codes, base)
        s, order, width = _Suffixes(hashed[base], row, col, length), start_order.copy(), 1
        sound = True  # colliding hashes may contradict each other: ranks then are no permutation
        with np.errstate(over="ignore"):
            while sound and width < size.max():
                run = local // width
                sib_lo = seg_lo + (run ^ 1) * width
                act = np.flatnonzero(sib_lo < seg_hi)
                lo, hi = sib_lo[act].copy(), np.minimum(sib_lo[act] + width, seg_hi[act])
                base_lo, me, is_right = lo.copy(), order[act], (run[act] & 1) == 1
                open_ = np.flatnonzero(lo < hi)
                while len(open_):
                    mid = (lo[open_] + hi[open_]) // 2
                    up = s.before(order[mid], me[open_], is_right[open_])
                    lo[open_[up]] = mid[up] + 1
                    hi[open_[~up]] = mid[~up]
                    open_ = open_[lo[open_] < hi[open_]]
                to = at.copy()
                to[act] = seg_lo[act] + (run[act] // 2) * 2 * width + (local[act] - run[act] * width) + (lo - base_lo)
                moved = np.full_like(order, -1)
                moved[to] = order
                order, width, sound = moved, 2 * width, bool((moved >= 0).all())
            if not sound:
                continue
            same = np.zeros(n, bool)
            pair = np.flatnonzero(seg[1:] == seg[:-1])
            same[pair + 1] = s.common(order[pair], order[pair + 1]) >= length
        k = np.flatnonzero(same)
        if s.verified(order[k - 1], order[k]):
            out = np.empty(n, np.int64)
            out[order] = np.cumsum(~same) - 1
            return out
    raise RuntimeError("hashes of all bases collided")


def all_offsets(scheme: Scheme, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which offsets of each context have a window (a row of booleans), and the same as bits (bit i: the window that begins lo + i units before the anchor)."""
    offsets = np.arange(scheme.lo, scheme.hi + 1)
    valid = (offsets[None, :] <= before[:, None]) & (scheme.window - offsets[None, :] <= after[:, None])
    return valid, (valid * (np.uint64(1) << np.arange(len(offsets), dtype=np.uint64))[None, :]).sum(1, dtype=np.uint64)


def equal_spans(codes: np.ndarray, row: np.ndarray, col: int, length: int) -> np.ndarray:
    """A number for each span that begins in column ``col``, equal for equal spans: sorted by whole hashes, checked unit by unit, with another base after a collision."""
    for base in (*BASES, *(int(x) | 1 for x in np.random.default_rng(5).integers(1 << 62, 1 << 63, 6))):
        h = np.zeros(len(row), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(col, col + length):
                h = h * np.uint64(base) + mix(codes[row, j].astype(np.uint64))
        _, first, out = np.unique(h, return_index=True, return_inverse=True)
        of = row[first[out]]
        if all((codes[row[at : at + CHUNK], col : col + length] == codes[of[at : at + CHUNK], col : col + length]).all() for at in range(0, len(row), CHUNK)):
            return out
    raise RuntimeError("hashes of all bases collided")


def repeated_offsets(scheme: Scheme, key: np.ndarray, least: np.ndarray, before: np.ndarray, after: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """For each of these contexts, no two alike, a bit for each offset whose window also occurs in a document smaller than ``least``, its own first one.

    SPANS windows or one offset are sorted at once. Of a key with more than CHUNK contexts no prefix hashes are kept: its windows
    are sorted offset by offset, by their whole hashes.
    """
    valid, _ = all_offsets(scheme, before, after)
    codes, out, hashed = scheme.codes(contexts, before, after), np.zeros(len(key), np.uint64), {}
    _, group = np.unique(key, return_inverse=True)
    one = len(key) > CHUNK and not group.any()
    step = 1 if one else max(1, SPANS // len(key))
    for at in range(0, valid.shape[1], step):
        c, i = np.nonzero(valid[:, at : at + step])
        if not len(c):
            continue
        i += at
        if one:
            same = equal_spans(codes, c, scheme.hi - scheme.lo - at, scheme.window)
        else:
            same = classes(hashed, codes, c, scheme.hi - scheme.lo - i, scheme.window, group[c] * valid.shape[1] + i)
        first = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, same, least[c])
        again = first[same] < least[c]
        np.bitwise_or.at(out, c[again], np.uint64(1) << i[again].astype(np.uint64))
    return out


def _blocks(parts: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int32()), "block": pa.array(list(parts.values()), pa.binary())})


def gathered(scheme: Scheme, b: pa.RecordBatch, count: int) -> dict[int, bytes]:
    """For each part the contexts of the batch's hits, each once, with all places that have it."""
    out: dict[int, bytes] = {}
    held: dict[str, list] = {k: [] for k in ("key", "doc", "n", "crc", "pos", "before", "after")}
    texts: list[bytes] = []
    for d, t, n, c, hits in zip(*(b.column(x) for x in ("doc_id", "text", "n", "crc", "hits")), strict=True):
        if not hits.is_valid:
            continue
        flat = hits.values
        pos, key = flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("key").to_numpy(zero_copy_only=False).astype(np.uint64)
        ctx, before, after = scheme.context(scheme.units(t.as_py()), pos)
        texts += ctx
        for name, v in zip(held, (key, np.full(len(pos), d.as_py()), np.full(len(pos), n.as_py()), np.full(len(pos), c.as_py()), pos, before, after), strict=True):
            held[name].append(v)
    if texts:
        flat = {k: np.concatenate(v) for k, v in held.items()}
        number: dict[tuple[int, int, bytes], int] = {}
        which = np.array([number.setdefault(x, len(number)) for x in zip(flat["key"].tolist(), flat["before"].tolist(), texts, strict=True)], np.int64)
        order = np.lexsort((which, flat["key"]))  # like contexts side by side compress well
        lead = np.flatnonzero(np.diff(which[order], prepend=-1))  # each context goes once, with all places that have it
        edges = np.searchsorted(flat["key"][order] >> KEY_BITS, np.arange(count + 1, dtype=np.uint64))
        for p in range(count):
            if edges[p] < edges[p + 1]:
                mine = order[edges[p] : edges[p + 1]]
                begin = lead[np.searchsorted(lead, edges[p]) : np.searchsorted(lead, edges[p + 1])]
                chosen = order[begin]
                some = [texts[i] for i in chosen.tolist()]
                places = {k: flat[k][mine].astype(np.int64 if k == "doc" else np.uint32) for k in ("doc", "n", "crc", "pos")}
                kinds = {k: flat[k][chosen].astype(np.uint64 if k == "key" else np.uint32) for k in ("key", "before", "after")}
                size = np.array([len(x) for x in some], np.uint32)
                out[p] = pack(**places, **kinds, per=np.diff(begin, append=edges[p + 1]).astype(np.uint32), size=size, text=np.frombuffer(b"".join(some), np.uint8))
    return out


def decided(scheme: Scheme, blocks: list[bytes]) -> pa.Table:
    """The places (doc_id, n, crc, pos, bits) of these contexts that have windows which also occur in a smaller document."""
    got = [unpack(b) for b in blocks]
    a = {k: np.concatenate([x[k] for x in got]) for k in got[0]}
    ends = np.cumsum(a["size"].astype(np.int64))
    data, number = a.pop("text").tobytes(), {}
    del got
    which = np.array([number.setdefault((k, b, data[x:y]), len(number)) for k, b, x, y in zip(a["key"].tolist(), a["before"].tolist(), (ends - a["size"]).tolist(), ends.tolist(), strict=True)], np.int64)
    of, first = np.repeat(which, a["per"]), np.unique(which, return_index=True)[1]
    texts, key, before, after = [x[2] for x in number], *(a[k][first].astype(t) for k, t in (("key", np.uint64), ("before", np.int64), ("after", np.int64)))
    del data, number
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, of, a["doc"])
    _, group, rivals = np.unique(key, return_inverse=True, return_counts=True)
    order = np.argsort(group, kind="stable")
    order = order[rivals[group[order]] > 1]
    begins = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
    found, at = np.zeros(len(key), np.uint64), 0
    while at < len(begins) - 1:  # whole keys, CHUNK contexts or one key
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + CHUNK, "right")) - 1)
        mine = order[begins[at] : begins[to]]
        found[mine] = repeated_offsets(scheme, key[mine], least[mine], before[mine], after[mine], [texts[i] for i in mine.tolist()])
        at = to
    bits = np.where(a["doc"] == least[of], found[of], all_offsets(scheme, before, after)[1][of])
    hit = np.flatnonzero(bits)
    return pa.table({"doc_id": a["doc"][hit], "n": a["n"][hit].astype(np.int64), "crc": a["crc"][hit].astype(np.int64), "pos": a["pos"][hit].astype(np.int32), "bits": bits[hit].astype(np.int64)})


def rows_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, and the text's length and checksum, which with doc_id name a row."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n"), F.crc32(text.cast("binary")).alias("crc"), *more)


KEYS = ["doc_id", "n", "crc"]


def find(rows: DataFrame, scheme: Scheme, parts: int | None = None) -> DataFrame:
    """(doc_id, n, crc, found): for each row of ``rows_of`` that repeats something, its anchors' (pos, bits)."""
    count = parts or partitions(rows.sparkSession)
    known = copies(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            meta = np.array([(d, n, c, len(p)) for d, n, c, p, _ in held], np.int64).reshape(-1, 4)
            pos, key = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
            owner = np.repeat(np.arange(len(held)), meta[:, 3])
            part = (key >> np.uint64(44)) % np.uint64(count)
            order, out = np.argsort(part, kind="stable"), {}
            edges = np.searchsorted(part[order], np.arange(count + 1))
            for p in range(count):
                mine = order[edges[p] : edges[p + 1]]
                if len(mine):
                    own, inner, per = np.unique(owner[mine], return_index=True, return_counts=True)
                    step = np.diff(pos[mine], prepend=0)
                    step[inner] = pos[mine][inner]
                    m = meta[own]
                    out[p] = pack(doc=np.diff(m[:, 0], prepend=0), n=m[:, 1].astype(np.uint32), crc=m[:, 2].astype(np.uint32), per=per.astype(np.uint32), pos=step.astype(np.uint32), key=(key[mine] & ((np.uint64(1) << KEY_BITS) - np.uint64(1))))
            return _blocks(out)

        for b in batches:
            for d, t, n, c in zip(*(b.column(x) for x in ("doc_id", "text", "n", "crc")), strict=True):
                if t.is_valid and n.as_py() and d.is_valid:
                    with np.errstate(over="ignore"):
                        pos, key = scheme.anchors(scheme.units(t.as_py()))
                    if len(pos):
                        held.append((d.as_py(), n.as_py(), c.as_py(), pos, key))
                        total += len(pos)
                        if total >= FLUSH:
                            yield flush()
                            held, total = [], 0
        if held:
            yield flush()

    def shared(table: pa.Table) -> pa.Table:
        got = [unpack(b) for b in table["block"].to_pylist()]
        per = np.concatenate([x["per"] for x in got]).astype(np.int64)
        doc = np.concatenate([np.cumsum(x["doc"]) for x in got])
        n, crc = (np.concatenate([x[k] for x in got]).astype(np.int64) for k in ("n", "crc"))
        key = np.concatenate([x["key"] for x in got])
        step = np.concatenate([x["pos"] for x in got]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(per)[:-1]])
        run = np.cumsum(step)
        pos = run - np.repeat(run[begin] - step[begin], per)
        owner = np.repeat(np.arange(len(per)), per)
        order = np.argsort(key)
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        ids = doc[owner[order]]
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        keep = order[np.repeat(several, np.diff(np.concatenate([first, [len(k)]])))]
        o = owner[keep]
        part = np.uint64(table["part"][0].as_py()) << KEY_BITS
        return pa.table({"doc_id": doc[o], "n": n[o], "crc": crc[o], "pos": pos[keep].astype(np.int32), "key": (key[keep] | part).astype(np.int64)})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _blocks(gathered(scheme, b, count))

    def decide(table: pa.Table) -> pa.Table:
        return decided(scheme, table["block"].to_pylist())

    # Rows are joined by KEYS three times over: each reads the same exchange of the texts.
    originals = rows.join(known, KEYS, "left").select("doc_id", F.when(F.col("copied").isNull(), F.col("text")).alias("text"), "n", "crc")
    sent = originals.mapInArrow(send, "part int, block binary")
    candidates = sent.groupBy("part").applyInArrow(shared, "doc_id long, n long, crc long, pos int, key long")
    hits = candidates.groupBy(*KEYS).agg(F.collect_list(F.struct("pos", "key")).alias("hits")).hint("shuffle_hash")
    # A left join, as elsewhere, so that the exchange stays the same; rows without hits pass on no text.
    at_texts = rows.join(hits, KEYS, "left").select(*KEYS, F.when(F.col("hits").isNotNull(), F.col("text")).alias("text"), "hits")
    contexts = at_texts.mapInArrow(fetch, "part int, block binary")
    found = contexts.groupBy("part").applyInArrow(decide, "doc_id long, n long, crc long, pos int, bits long")
    return found.groupBy(*KEYS).agg(F.collect_list(F.struct("pos", "bits")).alias("found"))


def copies(rows: DataFrame) -> DataFrame:
    """(doc_id, n, crc, copied): the rows whose whole text is that of a smaller doc_id, by its length and MD5."""
    slim = rows.filter("doc_id is not null").select(*KEYS, F.md5(F.col("text").cast("binary")).alias("digest"))
    least = slim.groupBy("n", "digest").agg(F.min("doc_id").alias("least"))
    return slim.join(least, ["n", "digest"]).filter("doc_id > least").select(*KEYS).distinct().withColumn("copied", F.lit(True)).hint("shuffle_hash")


def with_found(rows: DataFrame, scheme: Scheme, parts: int | None = None) -> DataFrame:
    """Each row of ``rows_of`` with ``found``, null where nothing repeats, and ``copied``, true where all does."""
    found = find(rows, scheme, parts).hint("shuffle_hash")
    return rows.join(copies(rows), KEYS, "left").join(found, KEYS, "left")


def covered(scheme: Scheme, n_units: int, pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which units lie in a repeated window."""
    edge = np.zeros(n_units + 1, np.int64)
    for i, offset in enumerate(range(scheme.lo, scheme.hi + 1)):
        start = pos[(bits >> np.uint64(i)) & np.uint64(1) == 1] - offset
        np.add.at(edge, start, 1)
        np.add.at(edge, start + scheme.window, -1)
    return np.cumsum(edge[:-1]) > 0


def found_arrays(found) -> tuple[np.ndarray, np.ndarray] | None:
    """(pos, bits) of an Arrow list of structs."""
    if not found.is_valid or not len(found):
        return None
    flat = found.values
    return flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("bits").to_numpy(zero_copy_only=False).astype(np.uint64)
