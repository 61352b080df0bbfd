"""The pruned near-duplicate join and the greedy rule."""

import random

import numpy as np
import pytest

from loam.operators import corpus, near


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_ord long, embedding array<double>").repartition(3)


def clustered(seed, many=400, kinds=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, 12))
    return [(i, (centres[i % kinds] + rng.normal(size=12) * 0.08).tolist()) for i in range(many)]


@pytest.mark.parametrize("kind", ["clusters", "random", "odd"])
def test_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(1)
    rows = {
        "clusters": clustered(1),
        "random": [(i, rng.normal(size=4).tolist()) for i in range(300)],
        "odd": [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 0.0]), (9, [2.0, 2.0, 0.01]), (10, [float("inf"), 1.0])],
    }[kind]
    v = frame(spark, rows)
    want = sorted((r.a, r.b, round(r.sim, 9)) for r in corpus.near_pairs(v, 0.9).collect())
    assert sorted((r.a, r.b, round(r.sim, 9)) for r in near.pairs(v, 0.9, 16).collect()) == want and want
    assert near.pairs(v.limit(0)).count() == 0


def test_blocks_are_ruled_out(spark):
    r = near.compared(*near.plan(frame(spark, clustered(2)), 0.97, 8)).collect()[0]
    assert r.blocks >= 50 and r.all_pairs == r.blocks * (r.blocks + 1) // 2 and r.compared < r.all_pairs / 5


def greedy(links):
    earlier = {}
    for a, b in links:
        earlier.setdefault(b, []).append(a)
    out = set()
    for n in sorted(earlier):
        if any(a not in out for a in earlier[n]):
            out.add(n)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_rule(spark, seed):
    rng = random.Random(seed)
    links = {tuple(sorted(rng.sample(range(60), 2))) for _ in range([20, 60, 120, 400][seed])}
    got = [r.n for r in near.gone(spark.createDataFrame(sorted(links), "early long, late long")).collect()]
    assert sorted(got) == sorted(greedy(links))


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, plain = [], near.written
    monkeypatch.setattr(near, "written", lambda df, name: n.append(name) or plain(df, name))
    got = {r.n for r in near.gone(spark.range(10000).selectExpr("id AS early", "id + 1 AS late")).collect()}
    assert got == set(range(1, 10001, 2)) and len(n) < 25


def test_near_dedup(spark):
    rows = clustered(3, 200)
    v = frame(spark, rows + [(1000, None)])
    links = {(r.a, r.b) for r in corpus.near_pairs(v, 0.97).collect()}
    assert links and {r.chunk_ord for r in corpus.near_dedup(v, 0.97).collect()} == {i for i, _ in rows} - greedy(links) | {1000}


def test_dense_copies_come_in_strips(spark, monkeypatch):
    """Copies are all pairs: a task sends them as they are found, and holds few blocks."""
    monkeypatch.setattr(near, "STRIP", 8)
    n = 300
    v = frame(spark, [(i, [1.0, float(i % 2) * 1e-9]) for i in range(n)])
    assert near.pairs(v, 0.9, 32).count() == n * (n - 1) // 2
    i, m = np.arange(100), np.ones((100, 1))
    sizes = [b.num_rows for b in near._hits(i, m, i, m, True, 0.5)]
    assert sum(sizes) == 100 * 99 // 2 and max(sizes) <= 8 * 100


def test_a_block_is_sent_once_for_a_tile(spark):
    rng = np.random.default_rng(7)
    held, left = near.plan(frame(spark, [(i, rng.normal(size=8).tolist()) for i in range(800)]), 0.0, 8)
    sent = near.tiles(left)
    assert sent.count() < left.count() and sent.filter("size(ps) > 4").isEmpty()
    met = sent.filter("ps IS NOT NULL").selectExpr("explode(ps) AS p", "block AS q")
    assert sorted(met.collect()) == sorted(left.select("p", "q").collect())
