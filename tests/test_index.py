"""The stored index against BM25 over the texts themselves."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import index, retrieval
from loam.sources import versions

QUESTION = "alpha beta alpha 7 水 gamma"


def chunk_rows(rng, ids):
    words = ["Alpha", "beta", "gamma", "delta", "7", "水电", "epsilon", "x", ""]
    weight = [1, 2, 1, 9, 1, 1, 20, 9, 5]
    return [(rng.choice(["a", "b", None]), i, rng.choice([None, " ".join(rng.choices(words, weight, k=rng.randrange(30)))] + [" ".join(rng.choices(words, weight, k=rng.randrange(30)))] * 9)) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "kb string, chunk_ord long, text string").repartition(3)


def check(spark, root, rows, k=7):
    want = retrieval.bm25(frame(spark, rows), QUESTION).filter("bm25 > 0")
    full = {(r.kb, r.chunk_ord): r.bm25 for r in want.collect()}
    got = {(r.kb, r.chunk_ord): r.bm25 for r in index.scores(spark, root, QUESTION).collect()}
    assert got == full
    best = sorted(full.items(), key=lambda x: (-x[1], x[0][1]))[:k]
    assert [((r.kb, r.chunk_ord), r.bm25) for r in index.topk(spark, root, QUESTION, k).collect()] == best
    stores = {}
    for kb in {r[0] for r in rows}:
        own = frame(spark, [r for r in rows if r[0] == kb])
        stores |= {(r.kb, r.chunk_ord): r.bm25 for r in retrieval.bm25(own, QUESTION).filter("bm25 > 0").collect()}
    assert {(r.kb, r.chunk_ord): r.bm25 for r in index.scores(spark, root, QUESTION, ["kb"]).collect()} == stores


def test_upserts_deletions_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_BITS", 4)
    rng, root = random.Random(1), f"file://{tmp_path}/index"
    held = {(kb, i): (kb, i, t) for kb, i, t in chunk_rows(rng, range(300))}
    assert index.create(frame(spark, list(held.values())), root, buckets=8) == 0
    check(spark, root, list(held.values()))
    old = dict(held)
    for turn in range(3):
        fresh = chunk_rows(rng, rng.sample(range(400), 40))
        index.upsert(spark, root, frame(spark, fresh))
        held |= {r[:2]: r for r in fresh}
        gone = rng.sample(sorted(held, key=repr), 25) + [("a", 99999)]
        index.apply(spark, root, removed=spark.createDataFrame(gone, "kb string, chunk_ord long"))
        held = {k: v for k, v in held.items() if k not in gone}
    check(spark, root, list(held.values()))
    before = sorted(map(tuple, index.documents(spark, root).drop("doc").collect()), key=repr)
    index.compact(spark, root)
    assert len(versions.read(spark, root)[1]["segments"]) == 1
    assert sorted(map(tuple, index.documents(spark, root).drop("doc").collect()), key=repr) == before
    check(spark, root, list(held.values()))
    index.upsert(spark, root, frame(spark, [("a", 1, "alpha 水 7")]))
    check(spark, root, list((held | {("a", 1): ("a", 1, "alpha 水 7")}).values()))
    # An old version is still there.
    want = {(r.kb, r.chunk_ord): r.bm25 for r in retrieval.bm25(frame(spark, list(old.values())), QUESTION).filter("bm25 > 0").collect()}
    assert {(r.kb, r.chunk_ord): r.bm25 for r in index.scores(spark, root, QUESTION, version=0).collect()} == want


def test_a_question_reads_its_buckets_and_few_blocks(spark, tmp_path, monkeypatch):
    """The plan's partition filter names the question's buckets, and blocks under the floor aren't decoded."""
    monkeypatch.setattr(index, "BLOCK_BITS", 4)
    root = f"file://{tmp_path}/index"
    rows = [("a", i, "alpha " * (20 if i < 8 else 1) + "word " * (i % 7)) for i in range(1600)]
    index.create(spark.createDataFrame(rows, "kb string, chunk_ord long, text string").coalesce(1), root)
    import zlib

    plan = index.scores(spark, root, "alpha")._jdf.queryExecution().executedPlan().toString()
    assert f"bucket#" in plan and f"PartitionFilters: [bucket" in plan.replace("isnotnull(", "") and str(zlib.crc32(b"alpha") % index.BUCKETS) in plan
    decoded, plain = [], index._decoded
    monkeypatch.setattr(index, "_decoded", lambda rows, *more: decoded.append(rows) or plain(rows, *more))
    got = [(r.chunk_ord, r.bm25) for r in index.topk(spark, root, "alpha", 5).collect()]
    assert [i for i, _ in got] == [r.chunk_ord for r in retrieval.bm25(spark.createDataFrame(rows, "kb string, chunk_ord long, text string"), "alpha").orderBy(F.col("bm25").desc(), "chunk_ord").limit(5).collect()]
    assert decoded[-1].count() == 1 and index._Question(spark, root, "alpha", [], None).rows.count() == 100


def test_odd_input(spark, tmp_path):
    empty = f"file://{tmp_path}/empty"
    index.create(frame(spark, []), empty)
    assert index.topk(spark, empty, QUESTION).count() == index.scores(spark, empty, QUESTION).count() == 0
    root = f"file://{tmp_path}/odd"
    clash = frame(spark, [("a", 1, "alpha"), (None, 2, None), (None, 3, "")]).selectExpr("*", "1 AS seg", "2 AS doc", "3 AS tokens", "4 AS token", "5 AS block", "6 AS n", "7 AS bm25")
    index.create(clash, root)
    assert [tuple(r) for r in index.topk(spark, root, "alpha").select("kb", "chunk_ord").collect()] == [("a", 1)]
    assert index.topk(spark, root, "!!").count() == index.topk(spark, root, "nowhere").count() == 0
    with pytest.raises(ValueError):
        index.create(clash, root)
    with pytest.raises(Exception):
        versions.commit(spark, root, 0, {})


def test_hybrid(spark, tmp_path):
    rng, root = random.Random(2), f"file://{tmp_path}/index"
    rows = [(*r, [rng.gauss(0, 1) for _ in range(4)] if rng.random() < 0.8 else None) for r in chunk_rows(rng, range(200))]
    chunks = spark.createDataFrame(rows, "kb string, chunk_ord long, text string, embedding array<double>")
    query = spark.createDataFrame([([1.0, 0.5, -1.0, 0.0],)], "qv array<double>")
    index.create(chunks, root)
    cols = ["kb", "chunk_ord", "bm25", "norm", "vec", "score"]
    assert index.hybrid_topk(chunks.drop("text"), root, QUESTION, query, 9).select(*cols).collect() == retrieval.hybrid_topk(chunks, QUESTION, query, 9).select(*cols).collect()


@pytest.mark.parametrize("masks", [index.MASKS, 0])
def test_removed_chunks_are_found_by_bits(spark, monkeypatch, masks):
    monkeypatch.setattr(index, "MASKS", masks)
    numbers = [p * (1 << 33) + i for p in (0, 1, 5) for i in range(200)]
    docs = spark.createDataFrame([(s, "a", i, n, 1, ["x"]) for s in (0, 1) for i, n in enumerate(numbers)], "seg int, " + index.SCHEMAS["docs"])
    dead = {(s, n) for s in (0, 1) for n in numbers if (n * 7 + s) % 5 == 0 or n % 64 in (0, 63)}
    out = index._marked(docs, spark.createDataFrame(sorted(dead), index.SCHEMAS["dead"]))
    assert sorted((r.seg, r.doc) for r in out.collect()) == sorted(dead) and out.columns == docs.columns


def test_tokens_stay_and_postings_are_made_once(spark, tmp_path):
    root = f"file://{tmp_path}/x"
    chunks = spark.createDataFrame([(i, "a", f"word{i} other") for i in range(50)], "chunk_ord long, kb string, text string")
    index.create(chunks, root)
    index.apply(spark, root, removed=chunks.filter("chunk_ord < 20"))
    assert not (tmp_path / "x" / "gone").exists()
    assert index.documents(spark, root).count() == 30
    held = index._read(spark, root, {"segments": [{"name": "s", "seg": 0, "has": []}]}, "docs")
    plan = index._postings(held, 0, 4)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan  # its sample would make them all a first time


def test_workers_are_sent_few_documents_and_none_start_twice(spark, tmp_path, monkeypatch):
    size, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, held, plain, many = spark.conf.get(size), [], index._postings, spark.conf.get(rows)
    monkeypatch.setattr(index, "_postings", lambda *a: held.append(spark.conf.get(size)) or plain(*a))
    root = f"file://{tmp_path}/x"
    chunks = spark.range(0, 200, numPartitions=1).selectExpr("id AS chunk_ord", "'a' AS kb", "concat('alpha word', id) AS text")
    spark.conf.set(rows, 3)
    try:
        index.create(chunks, root)
    finally:
        spark.conf.set(rows, many)
    assert held == [f"{index.SENT}b"] and spark.conf.get(size) == before
    # What several batches bring is one block.
    assert index._Question(spark, root, "alpha", [], None).rows.select("n").collect() == [(200,)]
    # Rows of Python's own would be read by other workers than those of SQL.
    plan = index.topk(spark, root, "alpha word7", 5)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
    assert [r.chunk_ord for r in index.topk(spark, root, "alpha word7", 1).collect()] == [7]


@pytest.mark.parametrize("tokens", [1, 7, 1 << 19])
def test_any_cut_of_documents_gives_the_same_counts(spark, tmp_path, monkeypatch, tokens):
    monkeypatch.setattr(index, "TOKENS", tokens)
    rows = chunk_rows(random.Random(5), range(60))
    root = f"file://{tmp_path}/x"
    index.create(frame(spark, rows), root)
    check(spark, root, rows)


def test_frequencies_are_counted_from_postings(spark, tmp_path, monkeypatch):
    """Tokens of what is added are read once, for postings; those of what leaves give negative counts."""
    held, plain = [], index._dfs
    monkeypatch.setattr(index, "_dfs", lambda *a: held.append(a) or plain(*a))
    rows, root = chunk_rows(random.Random(6), range(80)), f"file://{tmp_path}/x"
    index.create(frame(spark, rows), root, buckets=4)
    assert not held
    index.apply(spark, root, removed=frame(spark, rows[:30]))
    assert len(held) == 1
    _, manifest = versions.read(spark, root)
    got = {(r.kb, r.token): r.n for r in index._read(spark, root, manifest, "dfs").groupBy("kb", "token").agg(F.sum("n").alias("n")).filter("n <> 0").collect()}
    want = {(r.kb, r.token): r.n for r in index.documents(spark, root).select("kb", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("kb", "token").agg(F.count("*").alias("n")).collect()}
    assert got == want and any(kb is None for kb, _ in want)
