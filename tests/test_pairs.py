"""Tasks that make pairs."""

from pyspark.sql import functions as F

from loam.operators import graph


def test_chunks_are_dealt_before_their_pairs_are_made(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRED", 50)
    dealt = graph.apart(spark.range(1000).select(F.col("id").alias("chunk_ord")).coalesce(1))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 16 and max(sizes) < 100


def test_pairs_of_chunks_of_many_terms_are_whole(spark, tmp_path, monkeypatch):
    from itertools import combinations

    from loam.plans.catalog import QUERIES

    monkeypatch.setattr(graph, "COUNTED", 100)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}ordword" for i in range(60)]
    texts = [" ".join(words)] * 2 + [" ".join(words[20:]), " ".join(words[:3]), words[0], "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.w for r in QUERIES["cooccurrence"](spark, str(tmp_path)).collect()}
    held = [set(t.split()) for t in texts if t]
    want = {(a, b): n for a, b in combinations(words, 2) if (n := sum({a, b} <= h for h in held)) >= 3}
    assert got == want and len(want) == 780 + 3
