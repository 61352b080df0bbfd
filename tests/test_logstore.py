"""The log-structured store against upserts of whole tables."""

import os
import random

import pytest

from loam.operators import corpus
from loam.sources import logstore, versions

SCHEMA = "src string, chunk_ord long, text string"


def batch(rng, sources, turn):
    return [(s, i, f"{turn} {s} {i}") for s in sources for i in range(rng.randrange(1, 4))]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_upserts_and_deletions(spark, tmp_path):
    rng, root = random.Random(4), f"file://{tmp_path}/store"
    of = lambda x: spark.createDataFrame(x, SCHEMA)
    held = of([])
    logstore.create(spark, root, held.schema, buckets=4, fanout=3)
    assert rows(logstore.read(spark, root)) == rows(logstore.counts(spark, root)) == []
    names, past = [*"abcdefgh", None], {}
    for turn in range(8):
        fresh = of(batch(rng, rng.sample(names, 3), turn))
        want = rows(upserted(spark, held, fresh))
        n = logstore.upsert(spark, root, fresh)
        if turn in (2, 5):
            out = [(x,) for x in rng.sample(names, 2)] + [("nowhere",)]
            n = logstore.delete(spark, root, spark.createDataFrame(out, "src string"))
            want = [r for r in want if (r[0],) not in out]
        held = of(want)
        past[n] = want
        assert rows(logstore.read(spark, root)) == want
        assert {r.src: r.n for r in logstore.counts(spark, root).collect()} == {s: sum(r[0] == s for r in want) for s in {r[0] for r in want}}
    assert len(versions.read(spark, root)[1]["deltas"]) <= 5
    for n, want in past.items():
        assert rows(logstore.read(spark, root, n)) == want
    assert rows(logstore.of_sources(spark, root, ["a", "c"])) == [r for r in want if r[0] in ("a", "c")]


def upserted(spark, held, fresh):
    """corpus.upsert with null sources as a source of their own."""
    named = lambda df: df.fillna("~null", "src")
    return corpus.upsert(named(held), named(fresh)).replace("~null", None, "src")


def test_writes_grow_with_the_batch(spark, tmp_path):
    root, path = f"file://{tmp_path}/store", str(tmp_path / "store")
    text = "".join(random.Random(1).choices("abcdefgh ", k=3000))
    big = spark.createDataFrame([(f"s{i}", i, text[i % 500 :] + str(i)) for i in range(2000)], SCHEMA)
    logstore.create(spark, root, big.schema, buckets=4)
    logstore.upsert(spark, root, big)
    before = size(path)
    logstore.upsert(spark, root, spark.createDataFrame([("s7", 0, "x"), ("s7", 1, "y"), ("new", 0, "z")], SCHEMA))
    assert size(path) - before < before / 50
    assert logstore.read(spark, root).count() == 2002
    plan = logstore.of_sources(spark, root, ["s7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [", 1)[1][:80]


def test_stream_batches_count_once(spark, tmp_path):
    root, src = f"file://{tmp_path}/store", f"file://{tmp_path}/in"
    first = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], SCHEMA)
    first.write.parquet(src)
    logstore.create(spark, root, first.schema)
    run = logstore.sink(root, "s")
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    n = versions.read(spark, root)[0]
    run(spark.createDataFrame([("a", 0, "other"), ("a", 1, "other")], SCHEMA), 0)
    assert versions.read(spark, root)[0] == n and rows(logstore.read(spark, root)) == rows(first)


def test_odd_columns(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    logstore.create(spark, root, spark.createDataFrame([], SCHEMA).schema)
    logstore.upsert(spark, root, spark.createDataFrame([("a", "t", 5)], "src string, TEXT string, more int"))
    assert rows(logstore.read(spark, root)) == [("a", None, "t")]
    with pytest.raises(ValueError):
        logstore.create(spark, f"{root}2", spark.createDataFrame([], "src string, _seq int").schema)
