"""What a search of an Elias-Fano sequence finds, and how much it reads for that."""

import numpy as np
import pytest

from loam.llm import ngram_lm
from loam.llm.elias_fano import EliasFano, encode


def reads(monkeypatch, of, action):
    """Low parts that `of` reads while the action runs, and what the action returns."""
    n, lows = [0], EliasFano.lows

    def counted(self, i):
        n[0] += len(i) if self is of else 0
        return lows(self, i)

    with monkeypatch.context() as m:
        m.setattr(EliasFano, "lows", counted)
        return action(), n[0]


@pytest.mark.parametrize("spread", ["even", "crowded"])
def test_a_full_bucket_is_searched_with_few_reads(monkeypatch, spread):
    """Most values share one high part, as the successors of a frequent word do."""
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 20, 60_000) if spread == "even" else (rng.random(60_000) ** 4 * (1 << 20)).astype(np.int64)
    v = np.unique(np.append(v, (1 << 36) - 1)).astype(np.uint64)
    e = EliasFano(encode(v))
    assert e.l >= 19
    x = np.unique(np.concatenate([v, v + np.uint64(1)]))
    found, n = reads(monkeypatch, e, lambda: e.find(x))
    assert (v[found[found >= 0]] == x[found >= 0]).all() and ((found >= 0) == np.isin(x, v)).all()
    assert n < (8 if spread == "even" else 14) * len(x)


@pytest.mark.parametrize("bits", [1, 8, 30, 47, 48, 49, 50, 57, 58, 61])
def test_low_parts_of_any_width(bits):
    """With few values the low parts are wide; the values at a bucket's edges are found too."""
    top = 1 << bits
    v = np.unique(np.array([0, 1, 2, top // 3, top // 2, top - 2, top - 1, top, 2 * top - 1, 3 * top], np.int64).clip(0)).astype(np.uint64)
    e = EliasFano(encode(v))
    x = np.unique(np.concatenate([v, v + np.uint64(1), np.maximum(v, np.uint64(1)) - np.uint64(1)]))
    found = e.find(x)
    assert (found == np.where(np.isin(x, v), np.searchsorted(v, x), -1)).all()
    assert (e.get(np.arange(len(v))) == v).all() and (e.successor(x) == np.searchsorted(v, x)).all()


@pytest.mark.parametrize("relative", [True, False])
def test_level_finds_each_number_under_its_parent(monkeypatch, tmp_path, relative):
    """Parents without nodes, with one and with many; numbers before, between and beyond theirs. Without positions
    among the parent's nodes the last number of a parent is found without a search."""
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 500, n)) for n in (0, 1, 1, 30, 0, 0, 200, 1, 2, 0)]
    parent, number = np.repeat(np.arange(10), [len(x) for x in own]), np.concatenate(own)
    (tmp_path / "shard").write_bytes(b"".join(ngram_lm.level_bytes(10, parent, number, -rng.random(len(parent)), -rng.random(10))))
    level = ngram_lm.Level(f"file://{tmp_path}/shard")
    p, x = np.repeat(np.arange(10), 502), np.tile(np.arange(502), 10)
    place = {pair: i for i, pair in enumerate(zip(parent.tolist(), number.tolist()))}
    found, back, rel = level.find(p, x, relative)
    assert found.tolist() == [place.get(pair, -1) for pair in zip(p.tolist(), x.tolist())]
    assert (back == level.back[p]).all()
    if relative:
        first = np.searchsorted(parent, p)
        assert (rel[found >= 0] == (found - first)[found >= 0]).all()
    else:
        last = np.array([(k, o[-1]) for k, o in enumerate(own) if len(o)]).T
        _, n = reads(monkeypatch, level.nodes, lambda: level.find(*last, False))
        assert n == 0
