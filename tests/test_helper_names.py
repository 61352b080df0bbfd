"""Operators over tables with a column for each name that they use themselves, with null keys, and over empty tables."""

import pytest
from pyspark.sql import functions as F

from loam.operators import corpus, graph, memo, near, package, retrieval, scan, trace

NAMES = "_k _s _any found _r r nth _df df _n _stop stop _before before used _d d _m _p p q _group _first _over _qv _qn _h _dl _tf _lo _hi _avg key _key o c m end b parts x y sentence pos s_score src_all i e norm fresh n_ seg doc block memo_text scan_part kinds row seen kind best parts k s root".split()
ROWS = [("a", 0, "gate check. The gate is closed now", "one", [1.0, 0.0]), (None, 1, "gate check. The gate is closed now", "two", [1.0, 0.01]), (None, 2, None, None, None), ("b", 3, "other words stand here", "one", [0.0, 1.0]), (None, 4, None, "two", [0.5, 0.5])]
EVENTS = [("a", 1, "ok", 2.0, 0), ("a", 2, "error", None, 1), (None, 3, "ok", 1.0, 2), (None, 3, "ok", 4.0, 3), ("b", None, "ok", 5.0, 4)]
HITS = [(1, 0.5, "one", "", "gate check. The gate is closed now", 1), (2, 0.4, None, None, "other words stand here. gate", 2)]

CHUNK_OPS = {
    "bm25": lambda d: retrieval.bm25(d, "gate check"),
    "bm25_by_store": lambda d: retrieval.bm25(d, "gate check", ["kb"]),
    "bm25_scaled_by_store": lambda d: retrieval.bm25_scaled(d, "gate", ["kb"]),
    "minmax": lambda d: retrieval.minmax(retrieval.bm25(d, "gate", ["kb"]), by=["kb"]),
    "hybrid_topk": lambda d: retrieval.hybrid_topk(d, "gate", query(d)),
    "multi_scope_topk": lambda d: retrieval.multi_scope_topk(d, "gate", query(d), public="a"),
    "vector_topk": lambda d: retrieval.vector_topk(d, query(d)),
    "exact_dedup": corpus.exact_dedup,
    "near_dedup": lambda d: corpus.near_dedup(d, 0.9),
    "near_pairs": lambda d: near.pairs(d, 0.9),
    "rebuild": lambda d: corpus.rebuild(d, 0.9),
    "promote": lambda d: corpus.promote(d, d.filter("chunk_ord = 3")),
    "source_filter": lambda d: corpus.source_filter_fallback(d, ["one"]),
    "source_filter_none": lambda d: corpus.source_filter_fallback(d, ["nowhere"]),
    "chunk_search": lambda d: corpus.chunk_search(d, "gate"),
    "kb_stats": corpus.kb_stats,
    "take_while": lambda d: retrieval.include_then_stop(d, ["kb"], ["chunk_ord"], F.char_length("text"), 10),
    "numbered": lambda d: scan.numbered(d, ["chunk_ord"]),
    "postings": lambda d: graph.postings(d.select("*", F.explode(F.split("text", " ")).alias("term"))),
    "memo": lambda d: memo.reindex(d, scratch(d), "m", memo.hashed_tokens(4))[0],
}
EVENT_OPS = {
    "trace_stats": lambda d: trace.trace_stats(d),
    "trace_stats_newest": lambda d: trace.trace_stats(d, newest=2),
    "compact_history": lambda d: trace.compact_history(d.withColumn("ts", F.col("id")), "kind", 1),
    "motion_peaks": lambda d: trace.motion_peaks(d, "kind", ["ts", "id"], "secs", "a"),
    "smoothed": lambda d: trace.smoothed_envelope(d, "kind", ["ts", "id"], "secs"),
    "timeline": lambda d: package.timeline(d, ["kind"], "id", "secs"),
    "timeline_split": lambda d: package.timeline(d, ["kind"], "id", "secs", True),
    "timeline_of_all": lambda d: package.timeline(d, [], "id", "secs"),
    "newest": lambda d: scan.newest(d, ["kind"], [F.col("ts").desc(), "id"], 1),
    "history_last": lambda d: trace.history_last(d.withColumnsRenamed({"kind": "conv_id", "id": "turn"}), 1),
}
HIT_OPS = {
    "sentence_scores": lambda d: retrieval.sentence_scores(d, "gate closed"),
    "compress_context": lambda d: retrieval.compress_context(d, "gate closed"),
    "build_context": lambda d: retrieval.build_context(d, [], 60),
    "related_slide": lambda d: retrieval.related_slide(d, "ord"),
    "retrieve_multi": lambda d: retrieval.retrieve_multi(d.withColumn("q_ord", F.col("ord"))),
}
ALL = {k: ("chunks", f) for k, f in CHUNK_OPS.items()} | {k: ("events", f) for k, f in EVENT_OPS.items()} | {k: ("hits", f) for k, f in HIT_OPS.items()}


def query(d):
    return d.sparkSession.createDataFrame([([1.0, 0.0],)], "qv array<double>")


def scratch(d):
    from loam.sources.scratch import folder

    return folder(d.sparkSession, "memo-test")


def tables(spark):
    return {
        "chunks": spark.createDataFrame(ROWS, "kb string, chunk_ord long, text string, source string, embedding array<double>"),
        "events": spark.createDataFrame(EVENTS, "kind string, ts int, status string, secs double, id int"),
        "hits": spark.createDataFrame(HITS, "ord int, score double, label string, breadcrumb string, text string, page int").withColumn("rank", F.col("ord")),
    }


def rows(df, columns):
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ALL)
def test_own_names_are_free(spark, name):
    kind, op = ALL[name]
    plain = tables(spark)[kind]
    clash = plain.select("*", *[F.lit("clash").alias(c) for c in dict.fromkeys(NAMES) if c not in plain.columns])
    want, got = op(plain), op(clash)
    assert rows(got, want.columns) == rows(want, want.columns)
    kept = [c for c in got.columns if c in NAMES and c not in want.columns]
    assert all(set(r) <= {"clash"} for r in got.select(*kept).collect()) if kept else True


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, name):
    kind, op = ALL[name]
    assert op(tables(spark)[kind].limit(0)).count() in (0, 1)


def test_null_stores_are_stores(spark):
    d = tables(spark)["chunks"]
    assert retrieval.bm25(d, "gate", ["kb"]).count() == 5
    own = d.filter("kb IS NULL")
    got = {r.chunk_ord: r.bm25 for r in retrieval.bm25(d, "gate", ["kb"]).filter("kb IS NULL").collect()}
    assert got == {r.chunk_ord: r.bm25 for r in retrieval.bm25(own, "gate").collect()} and got[1] > 0
    hits = retrieval.multi_scope_topk(d, "gate", query(d), 5, public="a")
    assert 1 in [r.chunk_ord for r in hits.collect()]
