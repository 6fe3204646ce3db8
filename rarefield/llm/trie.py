"""A compact n-gram trie: Elias-Fano levels with quantised probabilities, read in place from one mapped buffer.

An increasing sequence is kept in the Elias-Fano form: the low bits of its values in
whole bytes, the high bits in unary, two bits a value or so.  A value is found by
successor search: a selection of zeros in the unary part gives the few values with
its high bits, whose low bits are searched.  Where a good part of the sequence is
asked for, all of it is decoded at once instead.

Levels: the words that stand last in a context (v); their successors (v, w); the
contexts (v, u), that is ``u v``; and the successors of these.  The last level
names a word by its place among the successors of v, so its numbers are as small as
these lists are short, and the lists' starts are monotone pointers.  Every level is
one sequence, so that a batch of look-ups is a handful of array operations.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

NONE = 255  # the code of what is not in the trie
STEPS = 24  # codes for each factor of ten

_POPULATION = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)
#: The place of the k-th zero bit of a byte, counted from its first bit.
_ZERO = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _zeros = np.flatnonzero(1 - np.unpackbits(np.array([_b], np.uint8)))
    _ZERO[_b, : len(_zeros)] = _zeros


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different whole numbers of ``x``, in order, and the place of each among them, as ``np.unique`` has them; sorted or dense ones without a sort."""
    if not len(x):
        return x, np.empty(0, np.int64)
    new = np.concatenate(([True], x[1:] != x[:-1]))
    if (x[1:] >= x[:-1]).all():
        return x[new], np.cumsum(new) - 1
    low = x.min()
    span = int(x.max()) - int(low) + 1
    if span > 2 * len(x):
        return np.unique(x, return_inverse=True)
    held = np.zeros(span, bool)
    held[x - low] = True
    return np.flatnonzero(held) + low, (np.cumsum(held) - 1)[x - low]


def quantised(p: np.ndarray) -> np.ndarray:
    """A byte for each probability: steps of the 24th root of ten, 254 at most."""
    return np.clip(np.rint(-STEPS * np.log10(p)), 0, NONE - 1).astype(np.uint8)


def probability(code: np.ndarray) -> np.ndarray:
    """What a code stands for; 0 for ``NONE``."""
    return np.where(code == NONE, 0.0, 10.0 ** (code.astype(np.float64) / -STEPS))


class Sequence:
    """A strictly increasing sequence of integers below 2**63 in the Elias-Fano form."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self._zeros = np.cumsum(8 - _POPULATION[high], dtype=np.int64)  # up to each byte's end
        self._top = int(self._zeros[-1]) if len(high) else 0

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        if not n:
            return struct.pack("<qqq", 0, 0, 0)
        spread = int(values[-1]) // n
        width = (max(0, spread.bit_length() - 1) + 7) // 8  # bytes of low bits
        high = (values >> np.int64(8 * width)) + np.arange(n)
        bits = np.zeros(int(high[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(bits, high >> 3, np.uint8(128) >> (high & 7).astype(np.uint8))
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :width]
        return struct.pack("<qqq", n, width, len(bits)) + low.tobytes() + bits.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[Sequence, int]:
        n, width, size = struct.unpack_from("<qqq", data, at)
        at += 24
        low = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        high = np.frombuffer(data, np.uint8, size, at + n * width)
        return cls(n, width, low, high), at + n * width + size

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``h``."""
        k = h - 1
        byte = np.minimum(np.searchsorted(self._zeros, k, "right"), len(self.high) - 1)
        skipped = k - (self._zeros[byte] - (8 - _POPULATION[self.high[byte]]))
        place = byte * 8 + _ZERO[self.high[byte], np.clip(skipped, 0, 7)]
        return np.where(h <= 0, 0, np.where(k >= self._top, self.n, place - k))

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.width):
            out |= self.low[at, k].astype(np.int64) << np.int64(8 * k)
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is not in the sequence."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        if 4 * len(values) >= self.n:  # as good as all are asked: the sequence is decoded once
            every = self.values()
            at = np.searchsorted(every, values)
            return np.where(every[np.minimum(at, self.n - 1)] == values, at, -1)
        h = values >> np.int64(8 * self.width)
        a, b = self._before(h), self._before(h + 1)
        want = values & np.int64((1 << (8 * self.width)) - 1)
        live = np.flatnonzero(a < b)
        lo, hi, x = a[live], b[live], want[live]
        open_ = np.arange(len(live))
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < x[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        got = lo < b[live]
        got[got] = self._low(lo[got]) == x[got]
        out[live[got]] = lo[got]
        return out

    def values(self) -> np.ndarray:
        """All values, in order."""
        high = np.flatnonzero(np.unpackbits(self.high)).astype(np.int64) - np.arange(self.n)
        return (high << np.int64(8 * self.width)) + self._low(np.arange(self.n))

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.values()[places]


def _starts(groups: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` groups begins in a sorted array of group numbers."""
    return np.searchsorted(groups, np.arange(n + 1))


def _codes(p: np.ndarray) -> bytes:
    return struct.pack("<q", len(p)) + quantised(p).tobytes()


def build(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, total: np.ndarray, pair_mass: float, triple_mass: float) -> bytes:
    """The trie of distinct n-grams ``u v w`` with counts ``n``; a row with u < 0 counts ``v w`` alone.

    ``total`` is how often v occurs.  A successor's probability is its count over the
    context's count and a mass that the lower order shares out (Dirichlet smoothing).
    """
    words, place = distinct(np.concatenate([np.where(u < 0, w, u), w]))
    pu, pw = place[: len(u)], place[len(u) :]
    last, iv = distinct(v)
    first = np.empty(len(last), np.int64)
    first[iv] = np.arange(len(v))  # any row of v will do
    size = np.int64(len(words))
    pairs, ip = distinct(iv * size + pw)
    real = u >= 0
    alone = np.bincount(iv, ~real, minlength=len(last)) > 0  # v whose pairs are counted apart from the triples
    count = np.bincount(ip, np.where(real & alone[iv], 0, n), minlength=len(pairs))
    owner = pairs // size
    keep = count > 0
    contexts, ic = distinct((iv * size + pu)[real])
    seen = np.bincount(ic, n[real], minlength=len(contexts))
    begins = _starts(owner, len(last))
    lengths = np.diff(begins)
    base = np.concatenate(([0], np.cumsum(lengths[contexts // size]))).astype(np.int64)
    relative = ip[real] - begins[iv[real]]
    triples = base[ic] + relative
    order = np.argsort(triples)
    out = [
        Sequence.encode(last),
        Sequence.encode(words),
        Sequence.encode(pairs),
        Sequence.encode(begins + np.arange(len(begins))),  # made strict
        Sequence.encode(contexts),
        Sequence.encode(base + np.arange(len(base))),
        Sequence.encode(triples[order]),
        struct.pack("<q", len(pairs)) + np.where(keep, quantised(np.maximum(count, 1) / (total[first][owner] + pair_mass)), NONE).astype(np.uint8).tobytes(),
        _codes(triple_mass / (seen + triple_mass)),
        _codes((n[real] / (seen[ic] + triple_mass))[order]),
    ]
    return b"".join(out)


class Trie:
    """Look-ups in a trie that :func:`build` made."""

    def __init__(self, data: bytes):
        self._map = mmap.mmap(-1, max(1, len(data)))
        self._map.write(data)
        view, at = memoryview(self._map), 0
        parts = []
        for _ in range(7):
            part, at = Sequence.read(view, at)
            parts.append(part)
        self.last, self.words, self.pairs, begins, self.contexts, base, self.triples = parts
        self._begins = begins.values() - np.arange(begins.n)
        self._base = base.values() - np.arange(base.n)
        codes = []
        for _ in range(3):
            (n,) = struct.unpack_from("<q", view, at)
            codes.append(np.frombuffer(view, np.uint8, n, at + 8))
            at += 8 + n
        self.pair_code, self.mass_code, self.triple_code = codes

    def look_up(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of each n-gram: of ``u v w``, of the mass that ``u v`` leaves to the lower order, and of ``v w``; ``NONE`` for what was not seen."""
        size = np.int64(self.words.n)
        iv, pu, pw = (s.find(x)[back] for s, (x, back) in ((s, distinct(x)) for s, x in ((self.last, v), (self.words, u), (self.words, w))))
        triple, mass, pair = (np.full(len(v), NONE, np.uint8) for _ in range(3))
        ip = np.full(len(v), -1, np.int64)
        known = np.flatnonzero((iv >= 0) & (pw >= 0))
        asked, back = distinct(iv[known] * size + pw[known])
        ip[known] = self.pairs.find(asked)[back]
        hit = ip >= 0
        pair[hit] = self.pair_code[ip[hit]]
        ic = np.full(len(v), -1, np.int64)
        known = np.flatnonzero((iv >= 0) & (pu >= 0) & (u >= 0))
        asked, back = distinct(iv[known] * size + pu[known])
        ic[known] = self.contexts.find(asked)[back]
        known = ic >= 0
        mass[known] = self.mass_code[ic[known]]
        both = np.flatnonzero(known & hit)
        at = self.triples.find(self._base[ic[both]] + ip[both] - self._begins[iv[both]])
        triple[both[at >= 0]] = self.triple_code[at[at >= 0]]
        return triple, mass, pair
