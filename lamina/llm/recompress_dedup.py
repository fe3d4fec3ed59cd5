"""Exact deduplication of word windows by recompression (operator 8).

Each round names runs of equal symbols, then pairs whose symbols fall into the left and the right class, by names made from
their content, so that all tasks agree on a name without a table. What a name stands for depends only on words close by, so
equal passages have equal symbols inside. After two rounds a symbol spans up to four words, and any 13 words hold one whose
place is settled by them alone; of those in a window the one of least name is its anchor. Symbols shared by documents reveal
the repeats, and the words around them verify them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import byte_codes, encode, mix, prefix_hashes, span_hashes
from lamina.llm.repeats import Scheme, covered, found_arrays, rows_of, sliding, with_found

_CODES = byte_codes(2)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
ROUNDS = 2


def recompress(words: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and starts of the symbols after the given rounds. Words equal to a neighbour are named as runs and stay single: a run may go on beyond any window."""
    name, start = mix(words), np.arange(len(words))
    same = words[1:] == words[:-1]
    run = np.zeros(len(words), bool)
    run[1:] |= same
    run[:-1] |= same
    name = np.where(run, mix(name ^ np.uint64(0xA5A5A5A5A5A5A5A5)), name)
    for r in range(rounds):
        if len(name) < 2:
            break
        right = (mix(name + np.uint64(0x51ED270B * (r + 1))) & np.uint64(1)).astype(bool)
        join = ~right[:-1] & right[1:] & ~run[:-1] & ~run[1:]
        paired = np.flatnonzero(join)
        name[paired] = mix(name[paired] * np.uint64(0x9E3779B97F4A7C15) + name[paired + 1] + np.uint64(r))
        keep = np.ones(len(name), bool)
        keep[paired + 1] = False
        name, start, run = name[keep], start[keep], run[keep]
    return name, start


class Units:
    """The words of a text: its bytes, the words' bounds and hashes."""

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        gap = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        self.begin, self.end = edge[::2], edge[1::2]
        self._raw = raw

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix_hashes(_CODES[self._raw]), self.begin, self.end)


class WordWindows(Scheme):
    """Windows of words; anchors are symbols inside a window, MARGIN words from its ends."""

    MARGIN, LONGEST = 3, 2**ROUNDS

    def __init__(self, window: int = 13):
        if window < 2 * self.MARGIN + 2 * self.LONGEST - 1:
            raise ValueError("a window must hold a whole symbol between its margins")
        self.window, self.lo = window, self.MARGIN
        self.hi = window - self.MARGIN - 1
        if self.hi - self.lo > 62:
            raise ValueError("the window is too long")

    def units(self, text: str) -> Units:
        return Units(encode(text))

    def anchors(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        n = len(units.begin)
        if n < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        words = units.hashes()
        name, start = recompress(words)
        size = np.diff(np.concatenate([start, [n]]))
        core, count = self.window - 2 * self.MARGIN, n - self.window + 1
        least = np.full(count, _TOP)
        for k in range(1, self.LONGEST + 1):  # symbols of k words begin in core - k + 1 places of a window
            v = np.full(n, _TOP)
            mine = size == k
            v[start[mine]] = name[mine]
            least = np.minimum(least, sliding(v[self.MARGIN : n - self.MARGIN], core - k + 1, np.minimum)[:count])
        out, keys = [], []
        prefix = prefix_hashes(mix(words))
        for k in range(1, self.LONGEST + 1):
            width = core - k + 1
            pad = np.zeros(width - 1, np.uint64)
            top = sliding(np.concatenate([pad, least, pad]), width, np.maximum)  # at a: the largest least of windows that hold k words from a + MARGIN on
            mine = np.flatnonzero((size == k) & (start >= self.MARGIN) & (start - self.MARGIN < len(top)))
            chosen = mine[top[start[mine] - self.MARGIN] == name[mine]]
            a = start[chosen]
            inside = a + k + self.MARGIN <= n
            a, chosen = a[inside], chosen[inside]
            out.append(a)
            keys.append(mix(span_hashes(prefix, a - self.MARGIN, a + k + self.MARGIN) + name[chosen]))
        pos, key = np.concatenate(out), np.concatenate(keys)
        order = np.argsort(pos, kind="stable")
        return pos[order], key[order]

    def context(self, units: Units, pos: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        n = len(units.begin)
        before, after = np.minimum(pos, self.hi), np.minimum(n - pos, self.right)
        first, last = units.begin[pos - before].tolist(), units.end[pos + after - 1].tolist()
        return [units.data[a:b] for a, b in zip(first, last, strict=True)], before, after

    def codes(self, contexts: list[bytes], before: np.ndarray, after: np.ndarray) -> np.ndarray:
        out = np.zeros((len(contexts), self.hi + self.right), np.uint32)
        col = np.arange(out.shape[1])
        inside = (col >= self.hi - before[:, None]) & (col < self.hi + after[:, None])
        number: dict[bytes, int] = {}
        out[inside] = np.array([number.setdefault(w, len(number) + 1) for c in contexts for w in _WORD.findall(c)], np.uint32)
        return out


def dedup_words(docs: DataFrame, window: int = 13, parts: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by a space).

    Words are what stands between white space (space and bytes 9 to 13), unchanged. A word goes if a window of ``window`` words
    over it also starts in a document with a smaller doc_id. Null texts have no words; rows with a null doc_id keep all and
    remove nothing elsewhere; rows that share a doc_id do not remove each other's words. Other columns are ignored.
    """
    scheme = WordWindows(window)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
            for d, t, f, c in zip(*(b.column(x) for x in ("doc_id", "text", "found", "copied")), strict=True):
                words, got = _WORD.findall(encode(t.as_py())), found_arrays(f)
                kept = words
                if c.is_valid and len(words) >= window:
                    kept = []
                elif got:
                    gone = covered(scheme, len(words), *got)
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                text = b" ".join(kept)
                for k, v in zip(out, (d.as_py(), len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k.startswith("kept") else pa.int64()) for k, v in out.items()})

    return with_found(rows_of(docs), scheme, parts).select("doc_id", "text", "found", "copied").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
