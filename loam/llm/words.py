"""Word and shingle hashes of many texts at once, and exact shingle sets.

A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. Its hash has two lanes of 64 bits. A word of at most
SHORT bytes is packed with its length into 128 bits and permuted by a Feistel network: two different ones never agree in
both lanes. A longer word's hash is its BLAKE2b. Shingle hashes mix each lane apart from the other.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np

STEP_BYTES = 1 << 21
SHORT = 15


def mix(x):
    """The finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ROUNDS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]


def word_lanes(texts: list[bytes]):
    """(hashes of all words, in order, an array for each lane; how many words each text has)."""
    raw = b" ".join(texts).lower() + b" " * 17
    inside = _INSIDE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    x = eight[start] & _FIRST[np.minimum(size, 8)]
    y = eight[start + 8] & _FIRST[np.clip(size - 8, 0, 7)] | (size.astype(np.uint64) << np.uint64(56))
    for k in range(0, 4, 2):
        y = y ^ mix(x + _ROUNDS[k])
        x = x ^ mix(y + _ROUNDS[k + 1])
    for i in np.flatnonzero(size > SHORT).tolist():
        x[i], y[i] = np.frombuffer(blake2b(raw[start[i] : end[i]], digest_size=16).digest(), np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return (x, y), np.diff(np.searchsorted(start, ends), prepend=0)


def word_hashes(texts: list[bytes]):
    """The first lane, and how many words each text has."""
    lanes, n = word_lanes(texts)
    return lanes[0], n


def steps(column, most: int = STEP_BYTES):
    """An Arrow string column as runs of texts of some `most` bytes: (first row, encoded texts)."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


MUL = 0xC2B2AE3D27D4EB4F


def shingles(texts: list[bytes], k: int = 5):
    """(hashes of all k-word shingles, in order, two lanes; how many each text has). With fewer words the sequence is one."""
    lanes, n = word_lanes(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    mul = np.uint64(MUL)
    m = max(0, len(lanes[0]) - k + 1)
    whole = doc[:m] == doc[len(doc) - m :]
    both = np.empty((int(whole.sum()), 2), np.uint64)
    for lane in (0, 1):
        h = lanes[lane]
        s = h[:m]
        for j in range(1, k):
            s = mix(s * mul + h[j : m + j])
        both[:, lane] = s[whole]
    owner = doc[:m][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        few = np.empty((len(short), 2), np.uint64)
        for row, i in enumerate(short):
            x = np.full(2, n[i], np.uint64)
            for at in range(first[i], first[i + 1]):
                x = mix(x * mul + np.array([lanes[0][at], lanes[1][at]]))
            few[row] = x
        both, owner = np.concatenate([both, few]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        both, owner = both[order], owner[order]
    return both, np.bincount(owner, minlength=len(texts)).astype(np.int64)


class _Numbered(dict):
    def __missing__(self, key) -> int:
        self[key] = out = len(self)
        return out


def exact_sets(texts: list[bytes], k: int = 5) -> list:
    """For each text its set of k-word shingles, as a sorted array of numbers. Among the texts of one call equal numbers are
    equal shingles, word by word: words are numbered, not hashed, and shingles by the rank of their word numbers."""
    words, short = _Numbered(), _Numbered()
    lists = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in lists], np.int64)
    ids = np.fromiter(map(words.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
    base = np.int64(len(words) + 1)
    rank = ids
    for j in range(1, k):
        rank = rank[: len(ids) - j] * base + ids[j:]
        if j < k - 1:
            rank = np.unique(rank, return_inverse=True)[1]
    ends = np.cumsum(n)
    out = []
    for w, end, many in zip(lists, ends, n):
        if many >= k:
            out.append(np.unique(rank[end - many : end - k + 1]))
        else:
            out.append(np.array([-1 - short[tuple(w)]] if many else [], np.int64))
    return out
