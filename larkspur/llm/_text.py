"""Vectorised scanning of Arrow text columns: words, rolling hashes and minimizer segments.

Everything works on the UTF-8 bytes in the Arrow buffer with numpy; no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEED = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Odd bases, so that their powers can be inverted modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: Longest run of symbols that is hashed at once; bounds the memory of one block and fits a CPU's cache.
BLOCK = 1 << 17
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 4096)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            down = np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            have = (np.cumprod(up), np.cumprod(down))
        _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end and len(column) + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    base = offsets[0] if len(offsets) else 0
    return data[base : offsets[-1]], offsets - base


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first = np.empty(len(data), bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    first[edges] = inside[edges]
    last = np.empty(len(data), bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    ends = edges[1:] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: Words up to so many 8-byte pieces are hashed in numpy, longer ones one by one with BLAKE2.
PIECES = 16
_SMALL = tuple(U64((1 << (8 * k)) - 1) for k in range(8))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: 8-byte pieces chained through a finalizer, so no sums that could cancel."""
    size = ends - starts
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    pieces = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    masks = np.array([*_SMALL, U64(0xFFFFFFFFFFFFFFFF)])
    out = mix(size.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    live, at, rest = np.arange(len(starts)), starts, size
    with np.errstate(over="ignore"):
        for _ in range(PIECES):
            if not len(live):
                return out
            part = pieces[at] & masks[np.minimum(rest, 8)]
            out[live] = mix((out[live] ^ part) + U64(0xA0761D6478BD642F))
            more = rest > 8
            live, at, rest = live[more], at[more] + 8, rest[more] - 8
    for k in live.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def chained(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], each value chained through a finalizer; for spans of few values."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + U64(0xE7037ED1A0B428DB))
    with np.errstate(over="ignore"):
        for k in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > k) if (size <= k).any() else slice(None)
            out[live] = mix((out[live] ^ values[starts[live] + k]) + U64(0xA0761D6478BD642F))
    return out


#: A prime; sums of products modulo it have no structure that repetitive texts could cancel, as modulo 2**64 they have.
PRIME = (1 << 31) - 1
_P = U64(PRIME)
_LANES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    return (x & _P) + (x >> U64(31))


def _lane_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i < n."""
    have = _LANES.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(18, n.bit_length())
        made = []
        for b in (base, pow(base, -1, PRIME)):
            x = np.ones(1, np.uint64)
            while len(x) < size:
                x = np.concatenate((x, x * U64(pow(b, len(x), PRIME)) % _P))
            made.append(x)
        have = _LANES[base] = (made[0], made[1])
    return have


class Rolling:
    """Hashes of spans of one block of 64-bit values: two polynomials modulo PRIME, one for each half of a value."""

    def __init__(self, values: np.ndarray, salt: int):
        self.sums, self.down = [], []
        for lane in range(2):
            up, down = _lane_powers(BASES[salt] >> (20 + 7 * lane) & 0x3FFFFFFF | 1, len(values) + 1)
            half = values & _P if lane == 0 else values >> U64(33)
            prefix = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(_fold(half * up[: len(values)]), out=prefix[1:])
            self.sums.append(prefix)
            self.down.append(down)

    def spans(self, starts, ends, size=None) -> np.ndarray:
        """62 bits of hash of each values[start:end]; slices of equal spans may be given instead of indexes."""
        both = []
        for prefix, down in zip(self.sums, self.down, strict=True):
            x = _fold(_fold(prefix[ends] - prefix[starts]))
            x = _fold(_fold(x * (down[: len(prefix)][starts])))
            both.append(np.where(x >= _P, x - _P, x))
        with np.errstate(over="ignore"):
            out = (both[0] << U64(31)) | both[1]
            if size is not None:
                out = out + size.astype(np.uint64) * U64(0xA0761D6478BD642F)
            return mix(out)


def wide_hashes(values: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes, 124 bits together, of values[start:start + width]; the starts ascend."""
    out = np.empty((2, len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(starts[j - 1]) + width
        at = starts[i:j] - lo
        for k in (0, 1):
            out[k, i:j] = Rolling(values[lo:hi], k).spans(at, at + width)
        i = j
    return out[0], out[1]


def gram_hashes(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all n-grams of one block of symbols (bytes or 64-bit word hashes); those of bytes for short n only."""
    if values.dtype != np.uint8:
        return Rolling(values, BASES.index(base)).spans(slice(0, len(values) - n + 1), slice(n, None))
    up, down = powers(base, len(values) + 1)
    count = len(values) - n + 1
    with np.errstate(over="ignore"):
        prefix = np.empty(len(values) + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(BYTE_VALUE[values] * up[: len(values)], out=prefix[1:])
        return mix((prefix[n:] - prefix[:count]) * down[:count])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


#: Low bits of an order key hold the position in the block, so the leftmost of equal grams wins.
_POSITION = U64((1 << 21) - 1)


def segments(values: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Cut all windows of ``window`` symbols into runs that share their minimizer occurrence.

    ``bounds``: offsets of the documents in ``values``. Yields, block by block, arrays of: minimizer hash,
    hash of the run's symbols, document index, first window's start in the document, number of windows.
    A run has at most window - gram + 1 windows; no two windows of one run are equal, as the leftmost smallest
    gram of a window fixes its offset in it. Equal windows always have equal minimizer hashes.
    """
    width = window - gram + 1
    n = len(values)
    docs = np.flatnonzero(np.diff(bounds) >= window)
    if not len(docs):
        return
    lo, hi = bounds[docs], bounds[docs + 1] - window + 1  # window starts of each document
    at = 0
    while at < n - window + 1:
        end = min(at + BLOCK, n - window + 1)
        block = values[at : end + window - 1]
        grams = gram_hashes(block, gram, BASES[1])
        order = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        where = (sliding_min(order, width) & _POSITION).astype(np.int64)
        valid = np.zeros(end - at + 1, np.int8)
        a, b = np.searchsorted(hi, at, "right"), np.searchsorted(lo, end, "left")
        valid[np.maximum(lo[a:b], at) - at] += 1
        valid[np.minimum(hi[a:b], end) - at] -= 1
        inside = np.cumsum(valid[:-1], dtype=np.int8) > 0
        cut = np.empty(end - at, bool)
        cut[0] = True
        np.not_equal(where[1:], where[:-1], out=cut[1:])
        np.logical_or(cut[1:], inside[1:] != inside[:-1], out=cut[1:])
        cut[lo[(lo >= at) & (lo < end)] - at] = True
        starts = np.flatnonzero(cut)
        counts = np.diff(starts, append=end - at)
        keep = inside[starts]
        starts, counts = starts[keep], counts[keep]
        if len(starts):
            stop = starts + counts + window - 1
            if block.dtype != np.uint8:
                whole = Rolling(block, 2).spans(starts, stop, counts)
            else:
                up, down = powers(BASES[2], len(block) + 1)
                with np.errstate(over="ignore"):
                    prefix = np.empty(len(block) + 1, np.uint64)
                    prefix[0] = 0
                    np.cumsum(BYTE_VALUE[block] * up[: len(block)], out=prefix[1:])
                    whole = mix((prefix[stop] - prefix[starts]) * down[starts] + counts.astype(np.uint64))
            doc = docs[np.searchsorted(lo, starts + at, "right") - 1]
            yield grams[where[starts]], whole, doc, starts + at - bounds[doc], counts
        at = end


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end), touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.empty(len(starts), bool)
    new[0] = True
    np.greater(starts[1:], ends[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]
