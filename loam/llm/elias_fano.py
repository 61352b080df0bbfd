"""Elias-Fano coding of monotone sequences, vectorised over numpy and readable from a memory map.

A sequence of n values below u keeps the low l = floor(log2(u / n)) bits of each value packed, and the high parts in
unary: value i sets bit (value >> l) + i. That takes n * (2 + l) bits and a few. A count of the ones before every
256-bit block lets select and the successor search find their block; no table of 64-bit offsets is kept.
Layout: header of 5 little-endian uint64 (n, l, words of low bits, words of high bits, blocks), low words, high words,
block counts (uint32 each, padded to 8 bytes).
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

BLOCK = 4  # words


def encode(values, universe: int | None = None) -> bytes:
    """values: non-decreasing, non-negative integers."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    u = max(int(universe or 0), int(v[-1]) + 1) if n else 1
    l = max(0, (u // n).bit_length() - 1) if n else 0  # noqa: E741
    low = _pack(v & np.uint64((1 << l) - 1), l) if l else np.zeros(0, np.uint64)
    ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n, dtype=np.int64)
    words = (u >> l) + n + 1
    words = -(-words // 64)
    words += -words % BLOCK
    bits = np.zeros(words * 64, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").view(np.uint64)
    per = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK * 64), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)
    head = np.array([n, l, len(low), len(high), len(before)], np.uint64)
    pad = b"\0" * (-before.nbytes % 8)
    return b"".join((head.tobytes(), low.tobytes(), high.tobytes(), before.tobytes(), pad))


def _pack(v, l: int):  # noqa: E741
    out = np.zeros(-(-len(v) * l // 64) + 1, np.uint64)
    at = np.arange(len(v), dtype=np.int64) * l
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    np.bitwise_or.at(out, word, v << shift)
    over = (shift.astype(np.int64) + l) > 64
    np.bitwise_or.at(out, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return out


def _select_table():
    """For each byte the positions of its bits, in order."""
    bits = (np.arange(1 << 8)[:, None] >> np.arange(8)) & 1
    value, place = np.nonzero(bits)
    out = np.zeros((1 << 8, 8), np.uint8)
    out[value, (np.cumsum(bits, axis=1) - 1)[value, place]] = place
    return out.ravel()


_SELECT = _select_table()
#: Low parts of at most this many bits lie in the 8 bytes that begin where they do.
NARROW = 57
#: Low parts of more bits are sought by halves alone: a double might place one behind the last.
EVEN = 48
#: Of so many probes one halves, however unevenly the values are spread.
HALVE = 3


class EliasFano:
    """Reads one encoded sequence; `size` is the bytes it takes of the buffer."""

    def __init__(self, buffer, offset: int = 0):
        n, l, lows, highs, blocks = (int(x) for x in np.frombuffer(buffer, np.uint64, 5, offset))  # noqa: E741
        self.n, self.l = n, l
        at = offset + 40
        self.low = np.frombuffer(buffer, np.uint64, lows, at)
        self.eight = np.ndarray((max(0, 8 * lows - 7),), "<u8", buffer, at, (1,))
        at += 8 * lows
        self.high = np.frombuffer(buffer, np.uint64, highs, at)
        at += 8 * highs
        self.before = np.frombuffer(buffer, np.uint32, blocks, at)
        self.size = at + 4 * blocks + (-4 * blocks % 8) - offset

    def __len__(self) -> int:
        return self.n

    def lows(self, i):
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        if self.l <= NARROW:
            return (self.eight[at >> 3] >> (at & 7).view(np.uint64)) & np.uint64((1 << self.l) - 1)
        word, shift = at >> 6, (at & 63).view(np.uint64)
        two = self.low[word] >> shift
        # A shift by 64 isn't defined, so the upper word is shifted twice.
        two |= (self.low[np.minimum(word + 1, len(self.low) - 1)] << np.uint64(1)) << (np.uint64(63) - shift)
        return two & np.uint64((1 << self.l) - 1)

    def _select(self, rank, before, zeros: bool):
        """Positions of the bits of this rank; before: ones or zeros before each block."""
        block = np.searchsorted(before, rank, side="right") - 1
        left = (rank - before[block]).astype(np.uint8)  # below a block's 256 bits
        n = np.bitwise_count(self.high.reshape(-1, BLOCK)[block])
        if zeros:
            n = 64 - n
        upto, k, less = np.zeros(len(left), np.uint8), np.zeros(len(left), np.int64), np.zeros(len(left), np.uint8)
        for j in range(BLOCK - 1):
            upto = upto + n[:, j]
            past = left >= upto
            k += past
            less = np.maximum(less, upto * past)
        word = block * BLOCK + k
        w = self.high[word]
        return word * 64 + _in_word(~w if zeros else w, left - less)

    def get(self, i):
        """Values at the positions i."""
        i = np.asarray(i, np.int64)
        ones = self._select(i, self.before[:-1], False)
        return ((ones - i).astype(np.uint64) << np.uint64(self.l)) | self.lows(i)

    def get_two(self, i):
        """Values at the positions i and i + 1: the second is the next one bit."""
        i = np.asarray(i, np.int64)
        one = self._select(i, self.before[:-1], False)
        two = self._next_bit(one + 1, False)
        value = lambda at, k: ((at - k).astype(np.uint64) << np.uint64(self.l)) | self.lows(k)
        return value(one, i), value(two, i + 1)

    def all(self):
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        i = np.arange(self.n, dtype=np.int64)
        return ((ones - i).astype(np.uint64) << np.uint64(self.l)) | self.lows(i)

    @cached_property
    def zeros(self):
        """Zeros before each block."""
        return np.arange(len(self.before) - 1, dtype=np.int64) * (BLOCK * 64) - self.before[:-1].astype(np.int64)

    def bucket(self, h):
        """For each high part the positions [i, j) of the values that have it."""
        h = np.minimum(h, len(self.high) * 64 - self.n - 1)  # the last zeros stand behind all values
        start = np.zeros(len(h), np.int64)
        some = h > 0
        # Values of high part h lie between the zeros before and after it.
        if some.all():
            start = self._select(h - 1, self.zeros, True) + 1
        else:
            start[some] = self._select(h[some] - 1, self.zeros, True) + 1
        end, far = self._next_bit(start, True, 2)
        end[far] = self._select(h[far], self.zeros, True)
        return start - h, end - h

    def successor(self, x):
        """The position of the first value that is at least x; n if there is none."""
        x = np.asarray(x, np.uint64)
        lo, hi = self.bucket((x >> np.uint64(self.l)).astype(np.int64))
        low = x & np.uint64((1 << self.l) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.lows(mid) < low[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, x):
        """The position of a value equal to x, -1 if there is none; of equal values any. Most probes are where the
        value would lie if those between were evenly spread; each HALVE-th halves what is left."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        lo, hi = self.bucket((x >> np.uint64(self.l)).view(np.int64))
        live = np.flatnonzero(lo < hi)
        lo, hi, low = lo[live], hi[live], (x[live] & np.uint64((1 << self.l) - 1)).view(np.int64)
        # The low part sought is at least from_, which those at lo are too, and less than to, as those before hi at most are.
        from_, to = np.zeros(len(live), np.int64), np.full(len(live), 1 << min(self.l, EVEN), np.int64)
        probes = 0
        while len(live):
            probes += 1
            if self.l > EVEN or probes % HALVE == 0:
                at = (lo + hi) >> 1
            else:
                at = lo + ((low - from_) * ((hi - lo) / (to - from_))).astype(np.int64)
            value = self.lows(at).view(np.int64)
            hit = value == low
            out[live[hit]] = at[hit]
            less = value < low
            from_, to = np.where(less, value, from_), np.where(less, to, value)
            lo, hi = np.where(less, at + 1, lo), np.where(less, hi, at)
            rest = np.flatnonzero((lo < hi) & ~hit)
            live, lo, hi, low, from_, to = live[rest], lo[rest], hi[rest], low[rest], from_[rest], to[rest]
        return out

    def _next_bit(self, pos, zero: bool, words: int | None = None):
        """The first zero, or one, at or after each position. words: looks no further than so many words, and returns
        with the places found those rows of them whose bit lies beyond."""
        word = pos >> 6
        bits = (lambda k: ~self.high[k]) if zero else (lambda k: self.high[k])
        w = bits(word) & (~np.uint64(0) << (pos & 63).view(np.uint64))
        empty = np.flatnonzero(w == 0)
        while len(empty) and words != 1:
            word[empty] += 1
            w[empty] = bits(word[empty])
            empty = empty[w[empty] == 0]
            words = words and words - 1
        place = word * 64 + np.bitwise_count(~w & (w - np.uint64(1)))
        return place if words is None else (place, empty)


_LANES = {k: np.uint64(int(f"{k:02x}" * 8, 16)) for k in (0x01, 0x0F, 0x33, 0x55, 0x80)}


def _in_word(w, rank):
    """Position in the word of its bit of this rank."""
    one, two, four, eight = (np.uint64(k) for k in (1, 2, 4, 8))
    n = w - ((w >> one) & _LANES[0x55])
    n = (n & _LANES[0x33]) + ((n >> two) & _LANES[0x33])
    # A lane of 8 bits for each byte: the ones up to its end.
    upto = ((n + (n >> four)) & _LANES[0x0F]) * _LANES[0x01]
    left = rank.astype(np.uint64)
    past = (((left * _LANES[0x01]) | _LANES[0x80]) - upto) & _LANES[0x80]
    shift = np.bitwise_count(past).astype(np.uint64) * eight
    left -= ((upto << eight) >> shift) & np.uint64(0xFF)
    byte = (w >> shift) & np.uint64(0xFF)
    return shift.view(np.int64) + _SELECT[(byte * eight + left).view(np.int64)]
