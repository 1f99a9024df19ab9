"""The audio query against an independent computation; every byte counts."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from larkspur.llm import media, registry


def plain(payload: bytes):
    """Log-mel frames and energies by the formulas: zero stuffing, convolution, a DFT by sums, triangles."""
    up, down = media.UP, media.DOWN
    n = media.TAPS * up
    cut = 1 / max(up, down)
    h = [cut * np.sinc(cut * (i - (n - 1) / 2)) * (0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (n + 1))) for i in range(n)]
    total = sum(h)
    x = [(b - 128) / 128 for b in payload]
    out = []
    for i in range(-(-len(x) * up // down)):
        at = i * down + media.TAPS // 2 * up  # in the stuffed signal
        out.append(sum(x[j // up] * h[at - j] * up / total for j in range(max(0, -(-(at - n + 1) // up) * up), min(at + 1, len(x) * up), up) if 0 <= at - j < n))
    frames = max(1, -(-len(out) // media.HOP))
    out += [0.0] * ((frames - 1) * media.HOP + media.FRAME - len(out))
    window = np.array([math.sin(math.pi * (k + 0.5) / media.FRAME) ** 2 for k in range(media.FRAME)])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    rate = media.RATE * up / down
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(20) + (mel(rate / 2) - mel(20)) * k / (media.MELS + 1)) / 2595) - 1) for k in range(media.MELS + 2)]
    bank = np.array([[max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)] for f in (rate / media.FRAME * k for k in range(media.FRAME // 2 + 1))])
    mels, energy = [], []
    for k in range(frames):
        part = np.array(out[k * media.HOP : k * media.HOP + media.FRAME]) * window
        mels.append(np.log(np.abs(turn @ part) ** 2 @ bank + 1e-6))
        energy.append(10 * math.log10((part**2).mean() + 1e-9))
    return np.array(mels), energy


def plain_segments(energy):
    mean, on, found = sum(energy) / len(energy), False, []
    for k, e in enumerate([*energy, -math.inf]):
        if not on and e > mean + media.HIGH_DB:
            on, begun = True, k
        elif on and e < mean + media.LOW_DB:
            on = False
            found.append((begun, k))
    return found


@pytest.mark.parametrize("n", [1, 500, 576, 577, 3000])
def test_features_by_the_formulas(n):
    payload = media.padded_payload(("Some words, and é, 日本 then. " * (n // 10 + 1)).encode()[:n])
    tensors, spans, parts = media.loaded(media.stored(*media.analyse(payload)))
    mels, energy = plain(payload)
    assert np.allclose(tensors.reshape(-1, media.MELS)[: len(mels)], mels, atol=2e-2)
    assert parts == plain_segments(energy)
    assert spans[0, 0] == 0 and spans[-1, 1] >= len(payload) / media.RATE and (spans[1:, 0] == spans[:-1, 1]).all()


@pytest.mark.parametrize("units", [1, 2, 3, 7])
def test_every_byte_counts(units):
    samples = bytes(i * 37 % 251 for i in range(media.UNIT * units))
    base = media.described(*media.analyse(samples))
    for k in [*range(0, 300), *range(len(samples) - 300, len(samples))]:
        assert media.described(*media.analyse(samples[:k] + bytes([samples[k] ^ 64]) + samples[k + 1 :])) != base, k


def test_query(spark, small):
    got = {r.doc_id: r for r in registry.QUERIES["op8_audio_features"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    same = {}
    for r in rows:
        data = (r.text or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert x.media_bytes == len(payload) + 44 and x.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
        assert x.feature == media.described(*media.loaded(bytes(x.features)))
        assert same.setdefault(payload, (x.feature, x.features)) == (x.feature, x.features)


def test_query_edges(docs, texts):
    """Nulls, empty, long and repeated rows beside columns that have the operator's own names."""
    clash = docs.selectExpr("*", "1 as media", "2 as feature", "3 as payload", "4 as features")
    got = sorted((r.n_bytes, r.payload_sha256) for r in media.media_digests(clash).collect())
    assert got == sorted((len((t or "").encode()), hashlib.sha256(media.padded_payload((t or "").encode())).hexdigest()) for _, t in texts)
