"""Operator 8, media columns: audio features of 8-bit samples.

Bytes are stored as an unsigned 8-bit mono WAV, read back through its chunks, resampled by a polyphase filter (5/8,
five phases, centred so that the last sample counts as the first does), cut into overlapped frames for a log-mel
filterbank, and segmented by energy with hysteresis. The features of a row are tensors of one fixed shape
(FRAMES x MELS, the last padded) with the time span of each. They are stored as an Arrow stream with a fixed-shape
tensor column and two columns of seconds, the segments in its metadata, and what is said of them is read from there.

Each row is computed by itself in blocks of bounded size, so equal bytes give equal values wherever they stand, and
no row count or text length changes the memory of a task beyond its text's own size.

Defined results: null and empty texts are 576 bytes of 255 (n_bytes 0); repeated rows get equal results; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm._frames import documents, id_text, map_arrow
from larkspur.llm._text import buffers

UNIT, PAD = 576, b"\xff"
RATE, UP, DOWN = 16_000, 5, 8
FRAME, HOP, MELS, FRAMES = 256, 128, 20, 8
TAPS = 32
HIGH_DB, LOW_DB = 1.0, -1.0
BLOCK = 1 << 16


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM."""
    odd = b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(odd)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + odd


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filters(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass filter, one row for each phase, latest sample first."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: each output is one phase of the filter against the TAPS inputs around its time."""
    phases = _filters(up, down)
    n = (len(x) * up + down - 1) // down
    padded = np.concatenate((np.zeros(TAPS // 2 - 1, np.float32), x, np.zeros(TAPS // 2 + down + 1, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for r in range(up):
        at = np.arange(r, n, up) * down // up
        phase = phases[(r * down) % up]
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            step = down if len(part) < 2 else int(part[1] - part[0])
            out[r + i * up : r + (i + len(part)) * up : up] = windows[part[0] : part[-1] + 1 : step] @ phase
    return out


def _mel_bank(rate: float) -> np.ndarray:
    """Triangular filters, FRAME // 2 + 1 bins by MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_BANK = _mel_bank(RATE * UP / DOWN)
#: Without the zeros at its ends.
_WINDOW = (np.sin(np.pi * (np.arange(FRAME) + 0.5) / FRAME) ** 2).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames by MELS, and each frame's energy in dB. Each hop begun has a frame, the last ones padded with zeros."""
    hops = max(1, -(-len(x) // HOP))
    x = np.concatenate((x, np.zeros((hops - 1) * HOP + FRAME - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mels, energy = [], []
    for i in range(0, len(frames), 4096):
        part = frames[i : i + 4096] * _WINDOW
        power = np.abs(np.fft.rfft(part)) ** 2
        mels.append(np.log(power @ _BANK + 1e-6).astype(np.float32))
        energy.append(10 * np.log10((part**2).mean(axis=1) + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames: begun above the mean by HIGH_DB, ended below it by -LOW_DB."""
    mean = energy.mean()
    mark = np.where(energy > mean + HIGH_DB, 1, np.where(energy < mean + LOW_DB, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.concatenate(([0], np.where(known >= 0, mark[known], 0), [0]))
    turn = np.flatnonzero(np.diff(on))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def analyse(samples: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Tensors (n, FRAMES, MELS), their spans in seconds, and the segments' frames."""
    x = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    mel, energy = log_mel(x)
    n = -(-len(mel) // FRAMES)
    padded = np.full((n * FRAMES, MELS), np.log(np.float32(1e-6)), np.float32)
    padded[: len(mel)] = mel
    seconds = HOP * DOWN / (RATE * UP)
    starts = np.arange(n) * FRAMES
    spans = np.column_stack((starts, np.minimum(starts + FRAMES, len(mel)))) * seconds
    return padded.reshape(n, FRAMES, MELS), spans, segments(energy)


def padded_payload(text: bytes) -> bytes:
    return text + PAD * (-len(text) % UNIT or (UNIT if not text else 0))


def stored(tensors: np.ndarray, spans: np.ndarray, parts: list[tuple[int, int]]) -> bytes:
    """An Arrow stream of one record batch: fixed-shape tensors, their first and last second; the segments as metadata."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), FRAMES * MELS)
    tensor = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)), flat)
    batch = pa.RecordBatch.from_arrays([tensor, pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["tensor", "start", "end"])
    sink = pa.BufferOutputStream()
    schema = batch.schema.with_metadata({"segments": ",".join(f"{a}-{b}" for a, b in parts)})
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(batch.cast(schema))
    return sink.getvalue().to_pybytes()


def loaded(features: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The tensors, spans and segments of ``stored``."""
    with pa.ipc.open_stream(features) as source:
        table = source.read_all()
    tensors = table.column("tensor").combine_chunks().to_numpy_ndarray()
    spans = np.column_stack((table.column("start").to_numpy(), table.column("end").to_numpy()))
    marks = table.schema.metadata[b"segments"].decode()
    return tensors, spans, [tuple(map(int, x.split("-"))) for x in marks.split(",") if x]


def described(tensors: np.ndarray, spans: np.ndarray, parts: list[tuple[int, int]]) -> str:
    """A short form of the features: frames, each band's mean, a checksum of all values, the segments' frames."""
    frames = round(float(spans[-1, 1]) * RATE * UP / (HOP * DOWN))
    mean = tensors.reshape(-1, MELS)[:frames].mean(axis=0)
    return f"{frames};" + ",".join(f"{x:.2f}" for x in mean.tolist()) + f";{zlib.crc32(np.ascontiguousarray(tensors).tobytes()):08x};" + ",".join(f"{a}-{b}" for a, b in parts)


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload, media, features): the payload as read back from the WAV, and the stored features."""

    def step(batch: pa.RecordBatch):
        data, bounds = buffers(batch.column(1))
        raw = data.tobytes()
        for k in range(batch.num_rows):
            text = raw[bounds[k] : bounds[k + 1]]
            media = wav(padded_payload(text))
            payload = read_wav(media)[1]
            row = (pa.array([len(text)], pa.int64()), pa.array([payload], pa.binary()), pa.array([media], pa.binary()), pa.array([stored(*analyse(payload))], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *row], names=["doc_id", "n_bytes", "payload", "media", "features"])

    return map_arrow(id_text(docs, id_col, text_col), step, "doc_id long, n_bytes long, payload binary, media binary, features binary")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, features)."""

    def step(batch: pa.RecordBatch):
        data, bounds = buffers(batch.column(1))
        raw = data.tobytes()
        out: list[list] = [[] for _ in range(8)]
        for k in range(batch.num_rows):
            text = raw[bounds[k] : bounds[k + 1]]
            media = wav(padded_payload(text))
            payload = read_wav(media)[1]
            features = stored(*analyse(payload))
            row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), described(*loaded(features)), features)
            for x, v in zip(out, row, strict=True):
                x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "features"])

    return map_arrow(id_text(docs, id_col, text_col), step, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, features binary")


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))
