"""Personal data by patterns and a skip-chain conditional random field (operator 7).

Patterns give the base spans. The field labels the words that hold a digit or an @ sign: neighbours share potentials, and so
do a word and those like it (the same letters and digits, or the same long run of digits), however far away: the last one, and
the first that a pattern matches. Loopy message passing then carries a label to repeats that no pattern matches, such as a
number written again with other signs; it goes on in each document until its messages stand still. The
potentials are trained by pseudo-likelihood on the patterns' own labels, over a bounded sample in which half of the labelled
words hide what the patterns look at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ship

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: 0 is none, then the kinds.
LABELS = len(KINDS) + 1
SAMPLE_DOCS, EPOCHS, SURE = 3_000, 300, 0.95
#: Messages stand still if none changes by more; from this step on they are damped more each time, so that they always end.
STILL, SLOWER = 1e-3, 100
#: Texts and characters of a graph; a longer text is a graph of its own.
GRAPH_TEXTS, GRAPH_CHARS = 256, 4_000_000
#: Potential of two repeats with equal labels at least; characters between neighbours at most.
REPEAT, NEAR = 8, 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_MARKED = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_BEFORE = re.compile(r"([^\W\d_]+)[\W\d_]*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each @ sign: a name can only be the run of its characters that ends there, so nothing is scanned twice."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:  # stops at the @ sign before, so all is read once
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then start. Matches that fail a check are dropped and not tried again."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def show(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# ---------------------------------------------------------------- the field

_HASHED = 64
#: Features of a word that the patterns look at: hidden from half of the training words.
SURFACE = 6
FEATURES = SURFACE + 15 + _HASHED


def _feature(word: str, before: str) -> np.ndarray:
    f = np.zeros(FEATURES, np.uint8)
    digits = _DIGITS.findall(word)
    n = len(digits)
    f[0], f[1], f[2] = "@" in word, word.lstrip("(").startswith("+"), word.count(".") == 3
    f[3], f[4], f[5] = n >= 16 and n <= 19 and luhn("".join(digits)), "." in word, "-" in word
    f[SURFACE] = 1
    f[SURFACE + 1 + min(n, 20) // 2] = 1
    f[SURFACE + 12], f[SURFACE + 13] = n == len(word), n > 0.6 * len(word)
    if before:
        f[SURFACE + 15 + int.from_bytes(hashlib.blake2b(before.lower().encode("utf-8", "replace"), digest_size=2).digest(), "big") % _HASHED] = 1
    return f


class Graph:
    """The marked words of several texts, their edges, and what the patterns say of them."""

    def __init__(self, texts: list[str | None]):
        self.spans, self.base, self.doc, given, self.edges = [], [], [], [], ([], [])
        features = bytearray()
        for d, text in enumerate(texts):
            base = base_spans(text) if text else []
            self.base.append(base)
            if not text or not _MARKED.search(text):
                continue
            cover = sorted((a, b, 1 + KINDS.index(k)) for k, a, b in base)
            alike: dict[str, list[int]] = {}
            prev_end, c = -(1 << 60), 0
            for m in _NODE.finditer(text):
                core = _CORE.search(m[0])
                if not core:
                    continue
                a, b = m.start() + core.start(), m.start() + core.end()
                while c < len(cover) and cover[c][1] <= a:
                    c += 1
                inside = cover[c] if c < len(cover) and cover[c][0] < b else None
                label = inside[2] if inside else 0
                k = len(self.spans)
                before = _BEFORE.search(text[max(0, m.start() - 24) : m.start()])
                self.spans.append((a, b))
                self.doc.append(d)
                features += _feature(m[0], before[1] if before else "").tobytes()
                given.append(label)
                if m.start() - prev_end <= NEAR:
                    self.edges[0].append((k - 1, k))
                prev_end = m.end()
                word = core[0].lower()
                digits = "".join(_DIGITS.findall(word))
                keys = [f"w{word}" if len(word) >= 6 else ""] + [f"{t}{d}" for d in {digits, "".join(_DIGITS.findall(text[inside[0] : inside[1]])) if inside else ""} for t, d in (("d", d), ("s", d[-9:])) if len(d) >= 7]
                for key in sorted({*keys} - {""}):  # of a span of several words also the whole
                    alike.setdefault(key, []).append(k)
            pairs = set()
            for these in alike.values():
                matched = next((k for k in these if given[k]), these[0])
                pairs |= {*zip(these, these[1:], strict=False)} | {(min(matched, k), max(matched, k)) for k in these if k != matched}
            self.edges[1].extend(sorted(pairs))
        self.given = np.array(given, int)
        self.x = np.frombuffer(bytes(features), np.uint8).reshape(len(self.spans), FEATURES)


class Field:
    """Unary weights [features, labels] and potentials of neighbours and of repeats [labels, labels]."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def train(cls, texts: list[str], epochs: int = EPOCHS, seed: int = 3) -> Field:
        """Softmax regression of each word's label on its features and its neighbours' labels."""
        g, rng = Graph(texts), np.random.default_rng(seed)
        w = np.zeros((FEATURES + 2 * LABELS, LABELS))
        if not len(g.given):
            return cls(w[:FEATURES], np.zeros((LABELS, LABELS)), REPEAT * np.eye(LABELS))
        sums = []
        for edges in g.edges:
            around = np.zeros((len(g.given), LABELS))
            for a, b in edges:
                around[a, g.given[b]] += 1
                around[b, g.given[a]] += 1
            sums.append(around)
        seen = g.x.astype(float)
        hidden = (rng.random(len(seen)) < 0.5) & (g.given > 0)
        seen[hidden, :SURFACE] = 0
        seen[hidden, SURFACE + 14] = 1  # told apart from words that lack these signs
        x, y = np.hstack([seen, *sums]), np.eye(LABELS)[g.given]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, epochs + 1):  # Adam
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            grad = x.T @ (p - y) / len(x) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        chain, skip = w[FEATURES : FEATURES + LABELS], w[FEATURES + LABELS :]
        # Potentials are symmetric. A repeat attracts its own label by at least REPEAT, also where the sample has few repeats.
        even = lambda q: (q + q.T) / 2 - ((q + q.T) / 2).mean()
        skip = np.clip(even(skip), -4, REPEAT)
        skip[np.diag_indices(LABELS)] = np.maximum(skip.diagonal(), REPEAT)
        return cls(w[:FEATURES], np.clip(even(chain), -1, 1), skip)

    def beliefs(self, g: Graph) -> np.ndarray:
        """Label probabilities by loopy sum-product messages, in each document until they stand still, whatever others do; the patterns' words are fixed."""
        n, step = len(g.given), 1 << 16
        score = np.concatenate([g.x[at : at + step].astype(float) @ self.unary for at in range(0, n, step)]) if n else np.zeros((0, LABELS))
        fixed = g.given > 0
        score[fixed] = -30
        score[fixed, g.given[fixed]] = 0
        score -= score.max(1, keepdims=True)
        edges = [(a, b, 0) for a, b in g.edges[0]] + [(a, b, 1) for a, b in g.edges[1]]
        if edges:
            e = np.array(edges)
            src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            kind, pot = np.concatenate([e[:, 2], e[:, 2]]), np.exp(np.stack([self.chain, self.skip]))
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            doc, msg = np.array(g.doc)[src], np.zeros((len(src), LABELS))
            live, speed, t = np.arange(len(src)), 0.5, 0
            while len(live):
                total, t = score.copy(), t + 1
                np.add.at(total, dst[live], msg[live])
                out = total[src[live]] - msg[back[live]]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.empty_like(out)
                for k in (0, 1):
                    new[kind[live] == k] = np.log(out[kind[live] == k] @ pot[k] + 1e-30)
                change = speed * (new - new.max(1, keepdims=True) - msg[live])
                msg[live] += change
                moves = np.zeros(len(g.base), bool)
                moves[doc[live[np.abs(change).max(1) > STILL]]] = True
                live = live[moves[doc[live]]]
                speed *= 0.95 if t >= SLOWER else 1
            np.add.at(score, dst, msg)
        p = np.exp(score - score.max(1, keepdims=True)) if n else score
        return p / p.sum(1, keepdims=True)

    def added(self, g: Graph, sure: float = SURE) -> list[list[tuple[str, int, int]]]:
        """For each text the spans that the field adds: surely labelled words outside base spans; equal labels of neighbouring words join."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in g.base]
        if not len(g.given):
            return out
        p = self.beliefs(g)
        label = p.argmax(1)
        for k in np.flatnonzero((label > 0) & (g.given == 0) & (p.max(1) >= sure)).tolist():
            kind, (a, b), mine = KINDS[label[k] - 1], g.spans[k], out[g.doc[k]]
            if mine and mine[-1][0] == kind and a - mine[-1][2] <= 2 and not any(x < b and mine[-1][1] < y for _, x, y in g.base[g.doc[k]]):
                mine[-1] = (kind, mine[-1][1], b)
            else:
                mine.append((kind, a, b))
        return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Trains on at most ``sample_docs`` texts with a digit or @ sign, drawn by a hash of the text over the whole table."""
    marked = docs.filter(F.col("text").rlike("[0-9@]"))
    n = marked.count()
    share = int((1 << 20) * min(1.0, sample_docs / max(1, n)))
    drawn = marked.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share).select("text", F.xxhash64("text").alias("h")).dropDuplicates(["h"])
    return Field.train([r["text"] for r in drawn.orderBy("h").limit(sample_docs).collect()])


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts of base spans by kind, base_sha256, spans (base and added), n_added.

    Null texts count as empty. Offsets are code points, ends exclusive. Added spans never replace or overlap a base span's
    words. Texts of any length are read whole; repeated rows give equal values unless doc_id differs. Other columns are ignored.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(field)  # FEATURES x LABELS numbers
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum([len(t or "") for t in whole.column("text").to_pylist()])
            at = 0
            while at < whole.num_rows:
                end = int(np.searchsorted(size, (size[at - 1] if at else 0) + GRAPH_CHARS, "right"))
                b = whole.slice(at, max(1, min(GRAPH_TEXTS, end - at)))
                at += b.num_rows
                g = Graph(b.column("text").to_pylist())
                rows: dict[str, list] = {k: [] for k in names}
                for d, base, more in zip(b.column("doc_id").to_pylist(), g.base, shared.value.added(g), strict=True):
                    kinds = [s[0] for s in base]
                    values = (d, *(kinds.count(k) for k in KINDS), hashlib.sha256(show(base).encode()).hexdigest(), show(base + more), len(more))
                    for k, v in zip(names, values, strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])
