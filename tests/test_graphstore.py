"""The stored graph against rebuilds, and searches that end early."""

import random

from pyspark.sql import functions as F

from loam.operators import corpus, graph, graphstore
from loam.sources import ordered, versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_follows_upserts_and_deletions(spark, tmp_path, monkeypatch):
    """Chunks of more terms than they keep, so that changes of counts elsewhere change what they keep."""
    monkeypatch.setattr(graphstore, "FANOUT", 3)
    rng, root, held = random.Random(7), f"file://{tmp_path}/graph", {}
    graphstore.create(spark, root, most=4)
    for turn in range(6):
        fresh = {i: {rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 9))} for i in rng.sample(range(40), 12)}
        gone = rng.sample(sorted(held), min(3, len(held))) + [999]
        fresh = {k: v for k, v in fresh.items() if k not in gone}
        mentions = [(i, t) for i, ts in fresh.items() for t in ts] + [(i, "a") for i in list(fresh)[:2] if "a" in fresh[i]] + [(5000, None)]
        graphstore.apply(spark, root, spark.createDataFrame(mentions, "chunk_ord long, term string"), spark.createDataFrame([(i,) for i in gone], "chunk_ord long"))
        held = {k: v for k, v in held.items() if k not in gone} | fresh
        want = graph.postings(spark.createDataFrame([(i, t) for i, ts in held.items() for t in ts], "chunk_ord long, term string"), 4).persist()
        assert rows(graphstore.postings(spark, root)) == rows(want)
        assert rows(graphstore.edges(spark, root)) == rows(graph.edges(want))
        assert rows(graphstore.nodes(spark, root)) == rows(graph.nodes(want))
        want.unpersist()
    assert all(len(x) <= 2 for x in versions.read(spark, root)[1]["sums"].values())
    graphstore.apply(spark, root, removed=spark.createDataFrame([(i,) for i in held], "chunk_ord long"))
    assert graphstore.edges(spark, root, 1).count() == graphstore.nodes(spark, root, 1).count() == graphstore.postings(spark, root).count() == 0


def test_searches_end_early(spark, tmp_path):
    root = f"file://{tmp_path}/ordered"
    chunks = spark.range(4000).select(F.col("id").alias("chunk_ord"), F.concat(F.lit("text of "), (F.col("id") % 40).cast("string")).alias("text")).repartition(7)
    ordered.write(chunks, root, "chunk_ord", 16)
    hit = F.contains("text", F.lit("of 7"))
    got, files = ordered.first(spark, root, hit, 5)
    assert files == 1 and got.select("chunk_ord", "text").collect() == corpus.chunk_search(chunks, "of 7", 5).collect()
    got, files = ordered.first(spark, root, hit, 50)
    assert 1 < files < 16 and got.collect() == corpus.chunk_search(chunks, "of 7", 50).collect()
    got, files = ordered.first(spark, root, F.contains("text", F.lit("nowhere")), 5)
    assert files == 16 and got.count() == 0
    ordered.write(chunks.limit(0), root, "chunk_ord")
    assert ordered.first(spark, root, hit, 5)[0].count() == 0


def test_only_pairs_that_change_are_made(spark, monkeypatch):
    """A chunk that keeps what it kept is not paired again, and one that gains a term is paired with it alone."""
    m = spark.createDataFrame([(1, "a", True, True), (1, "b", True, True), (1, "c", True, True), (2, "a", True, True), (2, "b", True, True), (2, "d", True, True)], "chunk_ord long, term string, was boolean, now boolean")
    df = spark.createDataFrame([("a", 9), ("b", 8), ("c", 5), ("d", 1)], "term string, n long")
    assert graphstore._moved(m, df, df.limit(0), 2).count() == 0
    moved = graphstore._moved(m, df, spark.createDataFrame([("d", 9)], "term string, n long"), 2)
    assert [tuple(r) for r in moved.collect()] == [(2, ["d"], ["b"], ["a"])]
    assert rows(graphstore._pairs(moved)) == [("a", "b", -1), ("a", "d", 1)] and rows(graphstore._terms(moved)) == [("b", -1), ("d", 1)]
