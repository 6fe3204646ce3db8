"""Vectorised hashes of the words and word n-grams of whole texts.

Words are runs of bytes other than white space (``\\x20``, ``\\x09-\\x0D``) with
A-Z lower-cased.  A word's hash is a polynomial over random byte values modulo
2**64, read off one running sum per block of bytes, so no word becomes a Python
object.  Blocks end between words: memory is bounded whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_ALL = (1 << 64) - 1
_RNG = np.random.default_rng(20240229)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            step = np.full(max(n, BLOCK) + 1, _STEP, np.uint64)
            back = np.full(max(n, BLOCK) + 1, _BACK, np.uint64)
            step[0] = back[0] = 1
            cls.up, cls.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return cls.up, cls.down


def _block_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of one block; ``cuts`` are offsets at which a text ends."""
    gap = _GAP[data]
    word = ~gap
    begins = word.copy()
    begins[1:] &= gap[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= gap[1:]
    stops[inner - 1] = word[inner - 1]
    ends = np.flatnonzero(stops) + 1
    up, down = _Powers.upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _ODD), starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of many texts in one byte array.

    Returns (hashes, first word of each text and the total, start bytes, end bytes).
    """
    n = len(data)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:
            spaces = np.flatnonzero(_GAP[data[at:to]])
            if len(spaces):
                to = at + int(spaces[-1]) + 1
            else:
                while to < n and not _GAP[data[to]]:
                    to += 1
        low, high = np.searchsorted(offsets, [at, to])
        h, s, e = _block_words(data[at:to], offsets[low:high] - at)
        parts.append((h, s + at, e + at))
        at = to
    if parts:
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets), s, e


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one run of word hashes; the whole run as one where it is shorter, none of none."""
    k = len(hashes)
    if not k:
        return hashes
    width = min(n, k)
    total = np.full(k - width + 1, width * 0xA24BAED4963EE407 & _ALL, np.uint64)
    weight = int(_ODD)
    for i in range(width):
        total += (hashes[i : k - width + 1 + i] ^ np.uint64(weight)) * np.uint64(weight | 1)
        weight = (weight * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _ALL
    return mix(total)


def text_arrays(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of a string column, about ``limit`` bytes each; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, off, body = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        to = min(to, n)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
