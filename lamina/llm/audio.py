"""Audio features of documents (operator 3).

The bytes of a text, padded, are stored as an 8-bit mono WAV; the stored bytes are read back, resampled by a polyphase filter
(12 kHz to 8 kHz), cut into overlapping frames, turned into log-mel energies, pooled to a fixed shape over equal time spans,
and segmented by energy with hysteresis. ``tensor_blocks`` stores the pooled energies as fixed-shape Arrow tensors with
their time spans.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import crc, encode, ship

PAD, UNIT = b"\xff", 576
RATE, UP, DOWN, TAPS = 12_000, 2, 3, 24
FRAME, HOP, BANDS, SPANS = 256, 128, 24, 8
#: Samples that are resampled at once: memory stays bounded for very long texts. A multiple of DOWN * HOP.
CHUNK = DOWN * HOP * 512
#: Segments open above the first and close below the second, in standard deviations of the frames' log energy.
OPEN, CLOSE = 0.5, -0.25

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long, segments array<struct<start_s: double, end_s: double>>, logmel array<float>, span_s array<struct<start_s: double, end_s: double>>"


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded by 255 to a positive multiple of 576, and the length before."""
    data = encode(text)
    return data + PAD * (UNIT - len(data) if not data else -len(data) % UNIT), len(data)


def store(data: bytes) -> bytes:
    """A WAV of unsigned 8-bit samples: each byte is one sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def read(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _phases() -> np.ndarray:
    """The low-pass filter, a row for each phase, newest sample last."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.kaiser(UP * TAPS, 6.0)
    h *= UP / h.sum()
    return np.stack([h[p::UP][::-1] for p in range(UP)]).astype(np.float32)


def _mel() -> np.ndarray:
    """Triangles between equal steps of mel, over the bins of a frame."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = (f[:, None] - points[None, :-2]) / (points[1:-1] - points[:-2])
    fall = (points[None, 2:] - f[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_PHASES, _MEL, _WINDOW = _phases(), _mel(), np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Rational resampling by UP / DOWN; each output costs one phase of the filter."""
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    n = -(-len(x) * UP // DOWN)
    out = np.empty(n, np.float32)
    for r in range(UP):  # outputs r, r + UP, ...: their inputs are DOWN apart
        first, phase = r * DOWN // UP, r * DOWN % UP
        got = windows[first::DOWN] @ _PHASES[phase]
        out[r::UP] = got[: len(out[r::UP])]
    return out


def logmel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x bands) and log energy of the frames, chunk by chunk."""
    raw, mels, energy, rest = np.frombuffer(samples, np.uint8), [], [], np.zeros(0, np.float32)
    for at in range(0, len(raw), CHUNK):
        lead = raw[max(0, at - TAPS * DOWN) : at]  # what the filter still remembers
        x = (np.concatenate([lead, raw[at : at + CHUNK]]).astype(np.float32) - 128) / 128
        y = np.concatenate([rest, resample(x)[len(lead) * UP // DOWN :]])
        if at + CHUNK >= len(raw):
            y = np.concatenate([y, np.zeros(-(len(y) - FRAME) % HOP if len(y) > FRAME else FRAME - len(y), np.float32)])
        n = (len(y) - FRAME) // HOP + 1
        if n > 0:
            frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n] * _WINDOW
            power = np.abs(np.fft.rfft(frames)).astype(np.float32) ** 2
            mels.append(np.log(power @ _MEL + 1e-6))
            energy.append(np.log((frames * frames).mean(1) + 1e-9))
        rest = y[max(0, n) * HOP :]
    return np.concatenate(mels), np.concatenate(energy)


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Segments [first, last) of frames: opened above one threshold, kept until below the other."""
    z = (energy - energy.mean()) / (energy.std() + 1e-6)
    mark = np.where(z > OPEN, 1, np.where(z < CLOSE, -1, 0))
    known = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(known >= 0, mark[known], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: bytes) -> dict:
    mel, energy = logmel(samples)
    bounds = np.linspace(0, len(mel), SPANS + 1)
    total = np.concatenate([np.zeros((1, BANDS)), np.cumsum(mel, 0, dtype=np.float64)])
    lo, hi = np.floor(bounds[:-1]).astype(int), np.maximum(np.ceil(bounds[1:]).astype(int), 1)
    pooled = (total[hi] - total[lo]) / (hi - lo)[:, None]
    second = HOP / (RATE * UP / DOWN)
    spans = hysteresis(energy)
    digest = ",".join(f"{v:.2f}" for v in pooled.mean(0) + 0.0)
    return {
        "n_frames": len(mel),
        "n_segments": len(spans),
        "segments": [{"start_s": a * second, "end_s": (b - 1) * second + FRAME / HOP * second} for a, b in spans],
        "logmel": pooled.astype(np.float32).ravel().tolist(),
        "span_s": [{"start_s": float(a) * second, "end_s": float(b) * second} for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
        "feature": f"frames={len(mel)};segments={len(spans)};mel={digest}",
    }


def describe(text: str | None) -> dict:
    """All values of a text; equal texts give equal values."""
    data, n = payload(text)
    media = store(data)
    back = read(media)
    return {
        "n_bytes": n,
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": crc(back[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        **features(back),
    }


def audio_features(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty and gives one unit of padding. Rows may repeat and doc_id may be null. Texts of any length
    are processed whole, CHUNK samples at a time. An empty table gives an empty table.
    """

    ship(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_segments", "segments", "logmel", "span_s"]
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), span, pa.list_(pa.float32()), span], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [{"doc_id": i, **describe(t)} for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def to_tensors(rows: pa.Table) -> pa.Table:
    """Feature rows as (doc_id, logmel fixed-shape tensor SPANS x BANDS, spans fixed-shape tensor SPANS x 2)."""
    mel = pa.array(np.array(rows["logmel"].to_pylist(), np.float32).reshape(-1), pa.float32())
    spans = pa.array(np.array([[(s["start_s"], s["end_s"]) for s in r] for r in rows["span_s"].to_pylist()], float).reshape(-1), pa.float64())
    kind, kind2 = pa.fixed_shape_tensor(pa.float32(), (SPANS, BANDS)), pa.fixed_shape_tensor(pa.float64(), (SPANS, 2))
    a = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(mel, SPANS * BANDS))
    b = pa.ExtensionArray.from_storage(kind2, pa.FixedSizeListArray.from_arrays(spans, SPANS * 2))
    return pa.table({"doc_id": rows["doc_id"].combine_chunks(), "logmel": a, "spans": b})


def tensor_blocks(features_df: DataFrame) -> DataFrame:
    """The tensors of ``audio_features`` as Arrow IPC streams, a block for each batch: (n_rows, arrow)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t, sink = to_tensors(pa.Table.from_batches([b])), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as w:
                    w.write_table(t)
                yield pa.RecordBatch.from_pydict({"n_rows": pa.array([b.num_rows], pa.int64()), "arrow": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return features_df.select("doc_id", "logmel", "span_s").mapInArrow(run, "n_rows long, arrow binary")


def read_tensors(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()
