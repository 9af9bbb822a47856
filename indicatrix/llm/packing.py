"""Words, their hashes and packed integer arrays, in numpy: what tasks send each other instead of one row for each word."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from indicatrix.llm.common import WHITE

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text starts and the last one ends."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _IS_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of words before each text and after the last. outside names the bytes between words."""
    inside = ~outside[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    starts = np.flatnonzero(inside & (edges[:-1] | np.concatenate([[True], ~inside[:-1]]))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (edges[1:] | np.concatenate([~inside[1:], [True]]))) + 1 if len(data) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length: differences of prefix sums of byte * base^place, mixed. A segment of the bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + _SEGMENT, "right")))
        piece = data[low:int(ends[last - 1])].astype(np.uint64) + np.uint64(1)
        powers = np.full(len(piece), _BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * powers, out=sums[1:])
        powers[1:] = _BASE_INVERSE
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * powers[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = last
    return mix(out)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed string: each less its minimum, in as few bytes as hold it, byte planes apart."""
    import zstandard

    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        unsigned = a.dtype.kind == "u"
        low = int(a.min()) if len(a) else 0
        rest = a.astype(np.uint64) - np.uint64(low % 2**64)
        width = np.min_scalar_type(int(rest.max()) if len(a) else 0).itemsize
        parts += [struct.pack("<BBQq" if not unsigned else "<BBQQ", width, unsigned, len(a), low), rest.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(packed: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    out, at = [], 1
    for _ in range(raw[0]):
        width, unsigned, n, low = struct.unpack_from("<BBQQ" if raw[at + 1] else "<BBQq", raw, at)
        at += struct.calcsize("<BBQQ")
        rest = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(f"<u{width}").reshape(n) if n else np.zeros(0, np.uint8)
        whole = rest.astype(np.uint64) + np.uint64(low % 2**64)
        out.append(whole if unsigned else whole.view(np.int64))
        at += n * width
    return out


def pack_sorted(ascending: np.ndarray) -> bytes:
    """An ascending array of 64-bit numbers by its differences."""
    return pack(ascending[:1], np.diff(ascending))


def unpack_sorted(packed: bytes) -> np.ndarray:
    first, steps = unpack(packed)
    return np.cumsum(np.concatenate([first, steps]), dtype=np.uint64)
