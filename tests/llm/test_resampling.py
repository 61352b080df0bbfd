"""Importance resampling against one text at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from loam.llm import resampling


def grams(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=5, least=20, buckets=10000):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    held = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(bucket(x) for _, _, f in held for x in f), Counter(bucket(x) for text in target for x in grams(text)[1])
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    out = []
    for i, n, f in held:
        w = sum(math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = rank + 1
    return sorted(map(tuple, out), key=repr)


def check(spark, docs, target, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = resampling.resample(d, b, **kw)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, *[kw[k] for k in ("percent", "min_words") if k in kw])


@pytest.mark.parametrize("percent", [5, 50])
def test_random_texts(spark, monkeypatch, percent):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 700)
    rng = random.Random(percent)
    words = ["Alpha", "beta", "GAMMA", "7", "délta", "ÉCHO", "日本", "zeta_eta", "x", "--"]
    text = lambda k: rng.choice(" \n,").join(rng.choices(words, range(1, 11), k=k))
    check(spark, [(i, text(rng.randrange(60))) for i in range(200)], [text(30) for _ in range(20)], percent=percent)


def test_odd_rows(spark):
    long = "one two three four five six seven " * 4000
    docs = [(None, long), (None, "a b"), (1, None), (2, ""), (3, "... !!"), (4, long + "x"), (4, long + "x"), (5, "a")]
    check(spark, docs, ["one two", ""], percent=70, min_words=2)
    check(spark, docs, [], percent=100, min_words=1)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("x",)], "text string")
    clash = d.selectExpr("*", "1 AS score", "2 AS rank", "3 AS out", "4 AS place", "5 AS buckets", "6 AS weight")
    assert resampling.resample(clash, b).collect() and resampling.resample(d.limit(0), b).count() == 0
    with pytest.raises(ValueError):
        resampling.resample(d, b, buckets=1 << 17)
