"""Classifiers that compare compressed sizes under zstandard dictionaries (operators 1 and 5).

A class is a raw-content dictionary made of labelled texts. A text, in blocks, is encoded with the dictionary of each
class; the class whose dictionary saves most is the likeliest. Quality turns the normalised difference of two sizes into a
calibrated score; language takes the smallest size and rejects narrow margins. Dictionaries are fitted on a bounded sample
(``sample_bytes`` of text a class, drawn by a hash of the text over the whole table); scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.common import encode, fresh, held_out, prefix_hashes, ship, span_hashes

#: Bytes of text in a dictionary, and at most from one document.
DICTIONARY_BYTES, PIECE_BYTES = 110_000, 4_000
#: Documents a class may give to the fit: dictionary and calibration together.
SAMPLE_DOCS = 1_200
#: Bytes that are encoded at once: long texts would otherwise be their own dictionary.
BLOCK = 4_096
LEVEL = 5
#: Texts below SHORT bytes are encoded with each byte STRETCH times, as is their dictionary: a match costs some four bytes, so
#: short matches would not pay otherwise and all sizes be equal.
SHORT, SHORT_LEVEL, STRETCH = 256, 19, 4
MAX_CLASSES = 1_000

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> bytes:
    """Lower case, letters only: what tells languages apart."""
    return encode(_OTHER.sub(" ", f" {text} ".lower()))


_CLASS = np.array([ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), [10, ord("."), ord("|")])
_RUN = np.isin(np.arange(256), [ord("a"), ord("A"), ord("0")])


def shape(data: bytes) -> bytes:
    """How a text is built: runs of letters and digits become one symbol, a word like the one before it the byte 1, a line or sentence seen before the byte 2."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    with np.errstate(over="ignore"):
        prefix = prefix_hashes(raw.astype(np.uint64) + np.uint64(1))
    out, keep = _CLASS[raw], np.ones(len(raw), bool)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if len(begin) > 1:
        h = span_hashes(prefix, begin, end)
        same = np.flatnonzero((h[1:] == h[:-1]) & (end[1:] - begin[1:] == end[:-1] - begin[:-1])) + 1
        if len(same):
            mark = np.zeros(len(raw) + 1, np.int8)
            np.add.at(mark, begin[same], 1)
            np.add.at(mark, end[same], -1)
            keep &= np.cumsum(mark[:-1]) == 0
            out, keep[begin[same]] = out.copy(), True
            out[begin[same]] = 1
    stops = np.flatnonzero(_STOP[raw]) + 1
    begin = np.concatenate([[0], stops[stops < len(raw)]])
    end = np.concatenate([begin[1:], [len(raw)]])
    long = end - begin > 12
    begin, end = begin[long], end[long]
    if len(begin) > 1:
        h = span_hashes(prefix, begin, end)
        _, first = np.unique(h, return_index=True)
        again = np.ones(len(h), bool)
        again[first] = False
        if again.any():
            mark = np.zeros(len(raw) + 1, np.int8)
            np.add.at(mark, begin[again], 1)
            np.add.at(mark, end[again], -1)
            keep &= np.cumsum(mark[:-1]) == 0
            keep[begin[again]] = True
            out[begin[again]] = 2
    out = out[keep]
    if len(out) > 1:
        out = out[np.concatenate([[True], (out[1:] != out[:-1]) | ~_RUN[out[1:]]])]
    return out.tobytes()


class Sizes:
    """Compressed sizes of a text under each of several dictionaries. Pickles as the dictionaries alone."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries, self._coders = dictionaries, None

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.dictionaries, self._coders = state, None

    def _coder(self, data: bytes, level: int):
        import zstandard as z

        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, data: bytes) -> np.ndarray:
        if self._coders is None:
            self._coders = [(self._coder(d, LEVEL), self._coder(stretch(d[: DICTIONARY_BYTES // STRETCH]), SHORT_LEVEL)) for d in self.dictionaries.values()]
        if len(data) < SHORT:
            data = stretch(data)
            return np.array([len(short.compress(data)) for _, short in self._coders], float)
        view, n = memoryview(data), -(-len(data) // BLOCK)
        step = -(-len(data) // n)  # blocks of equal size
        blocks = [view[i : i + step] for i in range(0, len(data), step)]
        return np.array([sum(len(usual.compress(b)) for b in blocks) for usual, _ in self._coders], float)


def stretch(data: bytes) -> bytes:
    return np.repeat(np.frombuffer(data, np.uint8), STRETCH).tobytes()


def dictionary(texts: list[bytes], limit: int = DICTIONARY_BYTES) -> bytes:
    """A piece of each text, from anywhere in it by a hash, until the dictionary is full."""
    out, n = [], 0
    for t in texts:
        at = zlib.crc32(t) % max(1, len(t) - PIECE_BYTES + 1)
        piece = t[at : at + PIECE_BYTES][: limit - n]
        out.append(piece)
        n += len(piece) + 1
        if n >= limit:
            break
    return b"\n".join(out) or b" "


def sample(labelled: DataFrame, label: str, text: str, docs: int = SAMPLE_DOCS) -> pd.DataFrame:
    """At most ``docs`` different whole texts of each label, drawn by a hash of the text: two passes, and how many reach the driver is bounded."""
    labelled = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = labelled.groupBy(label).count().orderBy(F.desc("count")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    if not counts:
        return pd.DataFrame({"y": [], "t": []})
    draw = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r[label], min(1.0, docs / r["count"]))]), F.col(label))
    got = labelled.filter(draw < share).select(F.col(label).alias("y"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    got = got.dropDuplicates(["y", "h"]).withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h"))).filter(F.col("k") <= docs)
    return got.orderBy("h").toPandas()[["y", "t"]]


# ---------------------------------------------------------------- language


class LanguageModel:
    """Dictionaries of the languages and the temperature that turns sizes into a score."""

    def __init__(self, train: pd.DataFrame):
        counts = train["y"].value_counts()
        self.labels = sorted(counts.index)
        split = {k: [fold(t) for t in train["t"][train["y"] == k]] for k in self.labels}
        self.sizes = Sizes({k: dictionary(v) for k, v in split.items()})
        self.common = int(np.argmax([counts[k] for k in self.labels])) if self.labels else -1
        self.beta = 40.0
        tests = [(i, self.sizes(t)) for i, k in enumerate(self.labels) for t in split[k][-100:] if len(self.labels) > 1]
        if tests:
            best = lambda b: sum(np.log(max(1e-9, self._shares(s, b)[i])) for i, s in tests)
            self.beta = max((5.0, 10.0, 20.0, 40.0, 80.0), key=best)

    @staticmethod
    def _shares(s: np.ndarray, beta: float) -> np.ndarray:
        e = np.exp(-beta * (s - s.min()) / s.min())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (the next smallest size over the smallest, less one)."""
        if not self.labels or text is None or not _LETTER.search(text):
            return "und", 0.0, 0.0
        s = self.sizes(fold(text))
        best = int(s.argmin())
        if s[self.common] == s[best]:
            best = self.common
        margin = (float(np.partition(s, 1)[1]) / float(s[best]) - 1) if len(s) > 1 else 1.0
        return self.labels[best], float(self._shares(s, self.beta)[best]), margin


def fit_language(docs: DataFrame, docs_per_class: int = SAMPLE_DOCS) -> LanguageModel:
    """Learns from ``text`` and ``lang`` of rows that are not held out: at most ``docs_per_class`` different texts a language. Null or empty texts and null languages teach nothing; without any rows the model knows no language."""
    return LanguageModel(sample(docs.filter(~held_out(F.col("doc_id"))), "lang", "text", docs_per_class))


def identify(docs: DataFrame, model: LanguageModel, min_margin: float = 0.004) -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_margin and lang_rejected.

    A text that is null or has no letter is ``und`` with score 0 and is rejected; so is one whose two smallest sizes differ by
    less than ``min_margin``. On a tie the language with most training documents wins. Without training rows all is ``und``.
    Repeated rows get equal values; columns of these names are replaced.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)  # dictionaries: DICTIONARY_BYTES for each of MAX_CLASSES at most

    @F.pandas_udf("lang_pred string, lang_score double, lang_margin double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "lang_score", "lang_margin"])

    docs = docs.drop("lang_pred", "lang_score", "lang_margin", "lang_rejected")
    got = fresh(docs, "__p")[0]
    out = docs.withColumn(got, predict(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns], f"{got}.*")
    return out.withColumn("lang_rejected", (F.col("lang_pred") == "und") | (F.col("lang_margin") < min_margin))


# ---------------------------------------------------------------- quality


class QualityModel:
    """Good and bad dictionaries over the text and over its shape, and a logistic calibration of the size differences."""

    def __init__(self, train: pd.DataFrame, rounds: int = 60):
        self.weights, self.mean, self.scale, self.prior = None, None, None, 0.5
        texts = {k: [encode(t) for t in train["t"][train["y"] == k]] for k in (0, 1)}
        if not texts[0] or not texts[1]:
            self.prior = 1.0 if texts[1] else 0.0 if texts[0] else 0.5
            return
        half = {k: (v[: (2 * len(v) + 2) // 3], v[(2 * len(v) + 2) // 3 :] or v) for k, v in texts.items()}
        self.raw = Sizes({str(k): dictionary(v[0]) for k, v in half.items()})
        self.form = Sizes({str(k): dictionary([shape(t) for t in v[0]]) for k, v in half.items()})
        x = np.array([self.features(t) for k in (0, 1) for t in half[k][1]])
        y = np.array([k for k in (0, 1) for _ in half[k][1]], float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
        for _ in range(rounds):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def features(self, data: bytes) -> list[float]:
        form = shape(data)
        (rb, rg), (fb, fg) = self.raw(data), self.form(form)
        n = len(data) + 1
        d, e = (rb - rg) / (rb + rg), (fb - fg) / (fb + fg)
        return [d, e, e * min(len(form), 1000) / 1000, np.log(rg / n), np.log(fg / (len(form) + 1)), np.log((len(form) + 1) / n), float(np.tanh(8 * e))]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        x = (np.array(self.features(encode(text))) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + np.clip(x, -6, 6) @ self.weights[1:], -30, 30))))


def fit_quality(docs: DataFrame, labels: DataFrame, docs_per_class: int = SAMPLE_DOCS) -> QualityModel:
    """Learns from ``labels.quality`` of documents that are not held out: at most some ``docs_per_class`` different texts a class. Other columns are never read; null labels, ids and texts teach nothing, and of two labels of a document the worse holds."""
    marks = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y")).filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"))  # a repeated row counts once; of two labels the worse holds
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, docs_per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, docs_per_class / max(1, counts.get(0, 0))))
    drawn = F.broadcast(marks.filter(draw < share).orderBy("doc_id").limit(3 * docs_per_class))  # bounded by the limit
    got = docs.select("doc_id", "text").join(drawn, "doc_id").select("y", F.col("text").alias("t"), F.xxhash64("text").alias("h"))
    got = got.filter(F.col("t").isNotNull()).dropDuplicates(["y", "h"]).orderBy("h").limit(6 * docs_per_class).toPandas()
    return QualityModel(got)


def rate(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with quality_score (0 to 1, higher is better) and quality_pred.

    Null and empty texts are scored as the empty text; very long texts block by block; repeated rows alike. With training rows
    of one class only, or none, every score is that class, or 0.5.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)  # four dictionaries of DICTIONARY_BYTES

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.score(t) for t in texts], dtype=float)

    return docs.drop("quality_score", "quality_pred").withColumn("quality_score", score(F.col("text"))).withColumn("quality_pred", (F.col("quality_score") >= threshold).cast("int"))
