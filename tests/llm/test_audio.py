import hashlib
import zlib

import numpy as np

from lamina.llm import audio as A


def test_round_trip_and_padding():
    for text in (None, "", "a", "é" * 300, "x" * 576, "y" * 577):
        d = A.describe(text)
        raw = (text or "").encode()
        want = raw + b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
        assert d["n_bytes"] == len(raw) and d["payload_bytes"] == len(want) and d["payload_bytes"] % 576 == 0
        assert d["payload_sha256"] == hashlib.sha256(want).hexdigest() and d["tail_crc32"] == zlib.crc32(want[-32:])
        assert A.read(A.store(want)) == want and d["media_bytes"] == len(A.store(want))


def test_chunks_change_nothing(monkeypatch):
    x = np.random.default_rng(0).integers(0, 256, A.DOWN * A.HOP * 9 + 777).astype(np.uint8).tobytes()
    whole, energy = A.logmel(x)
    monkeypatch.setattr(A, "CHUNK", A.DOWN * A.HOP * 2)
    parts, energy2 = A.logmel(x)
    assert np.allclose(whole, parts, atol=1e-4) and np.allclose(energy, energy2, atol=1e-4)


def test_resample_keeps_a_tone():
    t = np.arange(12_000) / A.RATE
    y = A.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    f = np.abs(np.fft.rfft(y[200:-200] * np.hanning(len(y) - 400)))
    assert abs(f.argmax() * 8000 / (len(y) - 400) - 440) < 3 and abs(len(y) - 8000) <= 1


def test_hysteresis():
    e = np.array([0.0] * 10 + [5.0] * 5 + [2.6] * 3 + [0.0] * 10)
    assert A.hysteresis(e) == [(10, 18)]


def test_operator(spark, docs, odd):
    got = A.audio_features(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and all(len(r.logmel) == A.SPANS * A.BANDS and len(r.span_s) == A.SPANS for r in rows)
    block = A.tensor_blocks(got.limit(5)).first()
    t = A.read_tensors(bytes(block.arrow))
    assert t.schema.field("logmel").type.shape == [A.SPANS, A.BANDS] and t.num_rows == block.n_rows
    assert A.audio_features(odd).count() == 12 and A.audio_features(odd.limit(0)).count() == 0
