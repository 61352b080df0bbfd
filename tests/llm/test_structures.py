"""Elias-Fano sequences, word hashes, the packing program, odd sketches and the classes of characters."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import bpe, near_dedup, packing
from loam.llm.elias_fano import EliasFano, encode
from loam.llm.words import shingles, word_hashes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40) | st.integers(0, 50), max_size=300), st.integers(0, 7))
def test_elias_fano(values, offset):
    v = np.sort(np.array(values, np.uint64))
    e = EliasFano(b"x" * offset + encode(v, 2**41) + b"tail", offset)
    assert (e.all() == v).all()
    x = np.concatenate([v, v + np.uint64(1), np.array([0, 2**41], np.uint64)])
    assert (e.successor(x) == np.searchsorted(v, x)).all()
    assert ((e.find(x) >= 0) == np.isin(x, v)).all()
    if len(v):
        i = np.arange(len(v))
        assert (e.get(i) == v).all()
        if len(v) > 1:
            a, b = e.get_two(i[:-1])
            assert (a == v[:-1]).all() and (b == v[1:]).all()


def test_elias_fano_is_small():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 30, 100_000)).astype(np.uint64)
    assert len(encode(v)) * 8 / len(v) < 2 + np.log2((1 << 30) / len(v)) + 1


WORDY = st.text(alphabet="aAbé \n\t\x0b日", max_size=60)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDY, min_size=1, max_size=5))
def test_words_and_shingles(texts):
    h, n = word_hashes([t.encode() for t in texts])
    flat = [w for t in texts for w in words_of(t)]
    assert n.tolist() == [len(words_of(t)) for t in texts]
    assert len(set(h.tolist())) == len(set(flat)) and len({*zip(h.tolist(), flat)}) == len(set(flat))
    s, m = shingles([t.encode() for t in texts])
    want = []
    for t in texts:
        w = words_of(t)
        want.append([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    flat = [x for w in want for x in w]
    assert m.tolist() == [len(w) for w in want] and len({*zip(s[:, 0].tolist(), flat)}) == len(set(flat)) == len(set(s[:, 0].tolist())) == len(set(s[:, 1].tolist()))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=20))
def test_packing_plan(histogram):
    made = packing.plan(histogram, 64)
    total = {}
    for config, times in made:
        assert sum(n * k for n, k in config) <= 64 and times > 0
        for n, k in config:
            total[n] = total.get(n, 0) + k * times
    assert total == histogram
    least = -(-sum(n * c for n, c in histogram.items()) // 64)
    first_fit = sum(packing.best_fit(histogram, 64).values())
    assert least <= sum(t for _, t in made) <= first_fit + len(histogram)
    made_of, least_of = packing.bounded_plan(histogram, 64)
    assert least <= least_of <= sum(t for _, t in made_of)
    lp, _ = packing.configuration_lp(histogram, 64)
    used = {}
    for config, x in lp:
        for n, k in config.items():
            used[n] = used.get(n, 0) + k * x
    assert all(used[n] <= histogram[n] + 1e-6 for n in used)


def test_packing_bound_beats_the_volume():
    """Adverse histograms: pieces of which two, or three, fill a sequence badly. Volume says little there, the dual much."""
    for histogram, gap in (({33: 1000}, 0), ({22: 900}, 0), ({30: 500, 36: 300, 20: 200}, 0.02), ({n: 97 for n in range(17, 34)}, 0.02), ({n: 40 + n for n in range(1, 65)}, 0.01)):
        made, least = packing.bounded_plan(histogram, 64)
        sequences = sum(t for _, t in made)
        assert -(-sum(n * c for n, c in histogram.items()) // 64) <= least <= sequences <= least * (1 + gap) + 1
    rng = np.random.default_rng(8)
    whole = {int(n): int(c) for n, c in zip(*np.unique(np.clip(rng.lognormal(6, 1, 30000), 1, 2048).astype(int), return_counts=True))}
    made, least = packing.bounded_plan(whole)
    assert sum(t for _, t in made) <= least * 1.001 + 1


def test_packing_beats_best_fit():
    histogram = {31: 300, 33: 300, 22: 300, 21: 600}
    assert sum(t for _, t in packing.plan(histogram, 64)) == -(-sum(n * c for n, c in histogram.items()) // 64) or sum(t for _, t in packing.plan(histogram, 64)) <= sum(packing.best_fit(histogram, 64).values())


@pytest.mark.parametrize("size", [60, 400, 4000])
def test_odd_sketch_estimates(size):
    """The estimate is near the truth, and far closer than the margin that candidates are given."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10**9, size)]
    for share in (1.0, 0.95, 0.9, 0.86):
        other = base[: int(size * share)] + [f"v{i}" for i in range(size - int(size * share))]
        n, _, _, _, odd, filled, bins = near_dedup.sketch([" ".join(base).encode(), " ".join(other).encode()])
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        assert n.tolist() == [len(a), len(b)]
        if size < near_dedup.SMALL:
            ones = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum())
            assert len(a ^ b) * 0.9 <= ones <= len(a ^ b) and ones % 2 == len(a ^ b) % 2
        else:
            ones = int(np.bitwise_count((bins[0] ^ bins[1]).view(np.uint64)).sum())
            equal = (sum(filled) - near_dedup.differing(ones)) / 2
            assert abs(equal / max(filled) - len(a & b) / len(a | b)) < 0.09


@pytest.mark.parametrize("latin", [True, False])
def test_character_classes(latin):
    """Every character that the quick patterns may meet is split as the tokenizers library splits it."""
    t, w = bpe.tokenizer(), bpe.WordEncoder()
    inside = re.compile(f"[{bpe._py_class(bpe.LATIN if latin else bpe.STABLE)}]")
    chars = [c for c in map(chr, range(1, 0x110000)) if inside.match(c)]
    for c in chars if latin else chars[::41]:
        text = f"a{c}b 1{c}{c} z!{c} {c}9\n{c}"
        assert np.frombuffer(w.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_unusual_characters_are_split_by_the_library():
    t, w = bpe.tokenizer(), bpe.WordEncoder()
    stable = re.compile(f"[{bpe._py_class(bpe.STABLE)}]")
    odd = [c for c in map(chr, range(1, 0x110000)) if not stable.match(c) and not 0xD800 <= ord(c) < 0xE000]
    for c in odd[::1499]:
        text = f"a{c}b 1{c}{c}<|endoftext|> z!{c}  {c}9\n{c}<|endoftext|><|endoftext|>'s"
        words = w.split(text)
        assert "".join(words) == text
        assert [i for x in words for i in w.word(x)] == t.encode(text, add_special_tokens=False).ids, hex(ord(c))
