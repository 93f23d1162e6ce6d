"""Vectorised text scanning over Arrow buffers: words, hashes, shingles.

Everything here works on one slice of a batch at a time (``SLICE_BYTES`` of UTF-8, or one
longer document), so memory is bounded by the longest document and not by the batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U = np.uint64
#: Spans of more bytes are hashed by BLAKE2b, shorter ones in rounds of eight bytes over all spans at once.
LONG_SPAN = 128
#: What a round keeps of eight bytes of which so many belong to the span.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of rows; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    offs = np.frombuffer(raw[1], dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that never cross a row's border."""
    n = len(mask)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(mask[:-1], out=before[1:])
    before |= border[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(mask[1:], out=after[:-1])
    after |= border[1:]
    return np.flatnonzero(mask & before), np.flatnonzero(mask & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes.

    The state takes in eight bytes at a time and is mixed after each, so that, unlike a polynomial,
    it has no family of texts that collide whatever the constants are.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    open_ = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    for k in range(0, LONG_SPAN, 8):
        if k:
            open_ = open_[size[open_] > k]
        if not len(open_):
            break
        chunk = eight[starts[open_] + k] & _KEEP[np.minimum(size[open_] - k, 8)]
        h[open_] = mix((h[open_] ^ chunk) * _U(0xD6E8FEB86659FD93) + _U(0x2545F4914F6CDD1D))
    for i in np.flatnonzero(size > LONG_SPAN):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words between white space: hashes, starts, ends, and each row's first word."""
    starts, ends = runs(~IS_SPACE[data], offs)
    return span_hashes(LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, offs)


def shingles(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, and each row's first shingle.

    A row with fewer words has the whole sequence as its one shingle, and one without words none.
    """
    count = np.diff(first)
    out_count = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    out_first = np.concatenate([[0], np.cumsum(out_count)])
    row = np.repeat(np.arange(len(count)), out_count)
    at = np.arange(out_first[-1]) - out_first[row] + first[row]
    end = first[row + 1]
    h = np.full(len(at), width, dtype=np.uint64)
    for k in range(width):
        inside = at + k < end
        value = word[np.where(inside, at + k, 0)] if len(word) else h
        h = np.where(inside, mix(h * _U(0xC2B2AE3D27D4EB4F) + value), h)
    return h, out_first


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The unsigned CRC-32 of each byte span; ``before`` holds those of what each span continues.

    One round takes a byte of every span that is long enough, the longest spans first.
    """
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    state = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32) if before is None else ~before[order].astype(np.uint32)
    long_ = int(np.searchsorted(-size, -LONG_SPAN, side="left"))
    for i in range(long_):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(~state[i])))
    reach = np.searchsorted(-size, -np.arange(LONG_SPAN + 1), side="left")  # spans of more than k bytes come before reach[k]
    for k in range(LONG_SPAN):
        lo, hi = long_, int(reach[k])
        if hi <= lo:
            break
        some = state[lo:hi]
        state[lo:hi] = _CRC[(some ^ data[at[lo:hi] + k]) & np.uint32(0xFF)] ^ (some >> np.uint32(8))
    out = np.empty(len(at), dtype=np.uint32)
    out[order] = ~state
    return out


def crc32_bytes(byte: int, before: np.ndarray) -> np.ndarray:
    """The CRC-32s continued by one and the same byte."""
    state = ~before
    return ~(_CRC[(state ^ np.uint32(byte)) & np.uint32(0xFF)] ^ (state >> np.uint32(8)))
