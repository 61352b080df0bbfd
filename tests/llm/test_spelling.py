"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from loam.llm import spelling


def plain(rows, least=7, count=2, ratio=10, every=31):
    import re

    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= least:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, links = {}, {}
    for w in words:
        links[w] = [v for v in words if near(w, v)]
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(links[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def check(spark, rows, **kw):
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **kw).collect()
    names = {"least": "min_length", "count": "min_count", "ratio": "ratio", "every": "delete_every"}
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == plain(rows, **{k: kw[v] for k, v in names.items() if v in kw})


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    """Dense neighbourhoods: short words of few letters, doubled letters, all counts."""
    rng = random.Random(seed)
    letters = ["abé", "aAbB÷", "abcdeÿ"][seed]
    words = ["".join(rng.choices(letters, k=rng.randrange(3, 7))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, [2 ** rng.randrange(9) for _ in words], k=60))) for i in range(60)]
    check(spark, rows, min_length=3, min_count=1, ratio=2, delete_every=5)
    check(spark, rows, min_length=3, ratio=3, delete_every=0)


def test_chains_of_forms(spark):
    """Each form occurs three times as often as the one before: roots are ends of long chains."""
    words = ["abcdefghij"[:i] + "x" + "abcdefghij"[i + 1 :] for i in range(2)]
    chain = ["aaaaaaa" + "b" * i for i in range(9)]
    rows = [(i, " ".join([w] * 3**i)) for i, w in enumerate(chain)] + [(20, " ".join(words * 2))]
    check(spark, rows, ratio=3, delete_every=0)


def test_odd_rows(spark):
    long = "q" * 5000
    rows = [(None, "Letters letters lettérs letterss"), (None, "Letters letters"), (1, None), (2, ""), (3, f"{long} {long} {long}q {long}q"), (4, "12 !! 日本語"), (4, "lettérs×÷ lettérs×÷"), (4, "lettérs×÷ lettérs×÷")]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.selectExpr("*", "1 AS word", "2 AS n", "3 AS kind", "4 AS k1", "5 AS best", "6 AS name")
    assert spelling.variants(clash).columns == ["word", "form", "root", "n", "n_near", "form_n"] and spelling.variants(clash).count() == spelling.variants(docs).count()
    assert spelling.variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs, ratio=1)
