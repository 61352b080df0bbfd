"""Nulls, empty tables, ties, repeated rows and clashing columns; and the streams."""

import math
import random

from pyspark.sql import functions as F

from loam.operators import articles, corpus, graph, package, retrieval, trace
from loam.streaming import trace as streams

CHUNKS = "chunk_ord long, text string, breadcrumb string, source string, embedding array<double>, _n string, _df int, _tf int, _dl int, _avg int, _h int, k int, s string, root string"
ROWS = [(0, "gate check", None, "a", [1.0, 0.0]), (1, None, None, None, None), (2, "", "", "a", []), (3, "gate gate", "up", "b", [0.0, 0.0]), (4, "gate check", None, "a", [2.0, 0.0]), (5, "other", None, "c", [1.0, None]), (6, "three", None, "c", [1.0, 0.0, 0.0])]


def chunks(spark):
    return spark.createDataFrame([(*r, "x", 1, 1, 1, 1, 1, 1, "x", "x") for r in ROWS], CHUNKS)


def test_search(spark):
    d = chunks(spark)
    scored = retrieval.bm25(d, "gate")
    assert scored.columns == [*d.columns, "bm25"]
    got = {r.chunk_ord: r.bm25 for r in scored.collect()}
    assert got[3] > got[0] == got[4] > 0 == got[1] == got[2] == got[5]
    assert retrieval.bm25(d.limit(0), "gate").count() == 0 and all(r.bm25 == 0 for r in retrieval.bm25(d, "？").collect())
    best = retrieval.vector_topk(d, spark.createDataFrame([([1.0, 0.0],)], "qv array<double>"), 3).collect()
    assert [r.chunk_ord for r in best][:2] == [0, 4]
    assert retrieval.format_context(spark.createDataFrame([], "ord int, label string, text string")).first().context == ""


def test_near_pairs_of_odd_vectors(spark):
    assert [tuple(r)[:2] for r in corpus.near_pairs(chunks(spark), 0.9).collect()] == [(0, 4)]
    assert corpus.near_pairs(chunks(spark).limit(0)).count() == 0


def test_near_pairs_by_blocks(spark):
    rng = random.Random(2)
    v = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(150)]
    unit = [[x / math.sqrt(sum(y * y for y in e)) for x in e] for e in v]
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if sum(a * b for a, b in zip(unit[i], unit[j])) > 0.8}
    d = spark.createDataFrame(list(enumerate(v)), "chunk_ord long, embedding array<double>")
    for rows in (20, 4096):
        got = [(r.a, r.b) for r in corpus.near_pairs(d, 0.8, rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_corpus(spark):
    d = chunks(spark)
    stats = corpus.kb_stats(d).first()
    assert (stats.chunks, stats.exact_dup) == (7, 1) and corpus.kb_stats(d.limit(0)).first().chunks == 0
    kept = {r.chunk_ord for r in corpus.promote(d, d.filter("chunk_ord = 0")).collect()}
    assert kept == {1, 2, 3, 5, 6} and corpus.promote(d.limit(0), d).count() == 0
    named = spark.createDataFrame([("kb", 0, "a", None), ("kb", 1, "b", None)], "kb string, chunk_ord long, text string, revs array<struct<v:int,text:string,at:string,note:string>>")
    changes = spark.createDataFrame([("kb", 0, "x"), ("kb", 0, "y"), ("kb", 1, None), ("kb", 9, "z")], "kb string, chunk_ord long, new_text string")
    out = sorted((r.chunk_ord, r.text, len(r.revs)) for r in corpus.edit(named, changes, "t").collect())
    assert out == [(0, "y", 1), (1, "b", 0)]
    slugs = corpus.unique_slugs(d.select("s", "root", F.col("chunk_ord").alias("ord"), F.col("text").alias("name")))
    assert sorted(r.slug for r in slugs.collect()) == ["gate_check", "gate_check2", "gate_gate", "item", "item2", "other", "three"]


def test_graphs(spark):
    none = spark.createDataFrame([], "chunk_ord long, term string")
    assert graph.edges(none).count() == graph.nodes(none).count() == 0 and graph.nodes(none, seeds=("工期",)).first().df == 1
    chain = graph.augment_chain(none.select("chunk_ord"), none, graph.nodes(none), graph.edges(none), 3, 2)
    assert chain.count() == 0


def test_logs_and_packages(spark):
    none = spark.createDataFrame([], "ts string, kind string, status string, secs double")
    assert trace.trace_stats(none).count() == 0
    people = spark.createDataFrame([], "person string, ord int, is_default boolean, active string, avatars array<struct<avatar:string,file:string>>")
    out = package.resolve_person(spark.createDataFrame([(1, "a", None)], "id int, person string, avatar string"), people, spark.createDataFrame([], "file string")).collect()
    assert [tuple(r) for r in out] == [(1, None, None, None)]
    versions = spark.createDataFrame([], "project string, version string, ord int, title string, current boolean")
    assert [tuple(r) for r in package.version_create(versions, "p", "v1").collect()] == [("p", "v1", 1, "v1", True)]
    assert package.version_delete(versions, "p", "v1").count() == 0


def test_sessions(spark):
    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 00:20:00", 1), ("2024-01-01 01:00:00", 1), ("2024-01-01 00:00:00", 2)]
    events = spark.createDataFrame(rows, "ts string, user_id int").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.user_id, r.n) for r in streams.sessions(events).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_upsert_sink(spark, tmp_path):
    store, source = f"file://{tmp_path}/store", str(tmp_path / "in")
    schema = "src string, chunk_ord long, text string"
    empty = spark.createDataFrame([], schema)
    held = lambda s: empty if (x := streams.latest(s, store)) is None else x
    assert streams.latest(spark, store) is None
    for batch in ([("h1", 0, "a"), ("h1", 1, "b")], [("h1", 0, "a"), ("h1", 1, "b"), ("h2", 0, "c")], [("h1", 0, "A")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        q = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(streams.upsert_sink(store, held, corpus.upsert)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.src, r.text) for r in streams.latest(spark, store).collect()) == [("h1", "A"), ("h2", "c")]


def test_scaled_scores_are_those_of_minmax(spark):
    d = chunks(spark).withColumn("_m", F.lit(1)).withColumn("_lo", F.lit("x")).withColumn("_hi", F.lit("x"))
    for by in (None, ["source"]):
        want = retrieval.minmax(retrieval.bm25(d, "gate up", by), by=by)
        got = retrieval.bm25_scaled(d, "gate up", by)
        rows = lambda x: sorted((r.chunk_ord, round(r.bm25, 9), round(r.norm, 9)) for r in x.collect())
        assert rows(got) == rows(want) and sorted(got.columns) == sorted(want.columns)
    assert retrieval.bm25_scaled(d.limit(0), "gate").count() == 0


def test_articles_and_profiles(spark):
    none = spark.createDataFrame([], "doc_id int, text string, breadcrumb string, prefix string, title string, summary string, keywords string, faqs array<struct<q:string,a:string>>, category string")
    assert articles.article_lines(none).count() == articles.article_document(none, "a", "v", "o").count() == articles.article_index(none).count() == 0
    odd = spark.createDataFrame([(1, "|a|\n|b|c|\n\n|d|e|\n# x\n![](i)", "B", "P", "x"), (1, "", None, None, "x")], "doc_id int, text string, breadcrumb string, prefix string, l string")
    assert sorted((r.body, r.figures) for r in articles.article_lines(odd).collect()) == [([], []), (["【P】b：c。", "【P】d：e。"], [])]
    empty = spark.createDataFrame([], "name string, note string, tri_ends array<string>, four_platforms array<string>, metrics array<struct<name:string,meaning:string>>, terms array<struct<name:string,meaning:string>>, sources array<string>")
    assert package.profile_entry(empty).count() == package.profile_hint(empty).count() == package.profile_terms(empty).count() == 0
