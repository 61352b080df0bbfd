"""Top-k on small odd tables against all pairs: few candidates, mixed dimensions, huge components, repeated ids."""

import random

import pytest

from loam.llm import topk


def plain(rows, every, k=5):
    import math

    live = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for a, (q, v) in enumerate(live):
        if q % every == 0:
            scores = [(-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(live) if b != a and len(w) == len(v)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if -(2**63) <= -x[0] < 2**63)[:k])]
    return sorted(out)


def check(spark, rows, every=50):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(map(tuple, topk.search(d, d.filter(f"vec_id % {every} = 0")).collect()))
    assert got == plain(rows, every)


@pytest.mark.parametrize("many", range(1, 7))
def test_few_vectors(spark, many):
    check(spark, [(i, [i + 0.5, -1.0]) for i in range(many)])


def test_lone_dimensions(spark):
    check(spark, [(i, [1.0 * i, 2.0, 3.0]) for i in range(40)] + [(50, [1.0, 2.0]), (51, [3.0, 1.0])])


def test_large_components(spark):
    rows = [(i, [float(i), -1.0]) for i in range(1, 9)] + [(0, [1.0, 1.0]), (60, [1e8, 1e8]), (61, [-1e8, 3e7]), (100, [2e12, 1e13]), (62, [1e17, -1e17]), (63, [5e17, 4e16]), (150, [1e200, -1e200]), (64, [1.0, 1.0])]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, monkeypatch, seed):
    for name, n in (("BLOCK", 3), ("RUN", 2), ("QUERIES", 2), ("SUMMARIES", 2)):
        monkeypatch.setattr(topk, name, n)
    rng = random.Random(seed)
    rows = []
    for i in range(rng.randrange(5, 60)):
        v = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 0, 1, 9]) for _ in range(rng.choice([2, 2, 2, 3]))]
        rows += [(rng.choice([i, 0, 50]), v)] * rng.choice([1, 1, 2])
    check(spark, rows, 10)
