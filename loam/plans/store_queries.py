"""Queries of what is stored and scanned in ranges: the inverted index, the log of deltas, prefix scans, pruned near pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import tables
from loam.functions import text as T
from loam.operators import corpus as C
from loam.operators import graphstore, index, memo, near, package, scan
from loam.plans.chunk_queries import WHOLE
from loam.plans.corpus_queries import EDGES, EXACT, PLAY, WS, events
from loam.plans.retrieval_queries import CHUNKS, QUESTION, bm25_sql, chunks, fused_sql, query_vec, table
from loam.sources import logstore, ordered, readers
from loam.sources.scratch import folder, written

CHUNKED = WHOLE + "SELECT doc_id, ord::INT AS chunk_ord, piece AS text, '' AS breadcrumb FROM c"

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(fn):
        Q[name], SQL[name] = fn, sql
        return fn

    return add


def texts_of(spark, sf):
    """What an index reads of documents: no vectors."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_ord"), F.col("lang").alias("kb"), "text")


@query("index_topk", f"WITH {bm25_sql()} SELECT kb, chunk_ord, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0 ORDER BY b.bm25 DESC, chunk_ord LIMIT 20")
def _(spark, sf):
    root = folder(spark, "index")
    index.create(texts_of(spark, sf), root)
    return index.topk(spark, root, QUESTION, 20).select("kb", "chunk_ord", F.round("bm25", 6).alias("bm25"))


@query("index_hybrid_topk", f"WITH {fused_sql()} SELECT chunk_ord, source, round(bm25, 6) AS bm25, round(vec, 6) AS vec, round(score, 6) AS score FROM u ORDER BY u.score DESC, chunk_ord LIMIT 20")
def _(spark, sf):
    root, all_ = folder(spark, "index"), chunks(spark, sf).drop("text")
    index.create(texts_of(spark, sf), root)
    hits = index.hybrid_topk(all_, root, QUESTION, query_vec(spark, sf), 20)
    return hits.select("chunk_ord", "source", F.round("bm25", 6).alias("bm25"), F.round("vec", 6).alias("vec"), F.round("score", 6).alias("score"))


#: Benchmark items join as a store of their own, documents in German leave, and those in Spanish get the text of the next.
CHANGED = """chunks AS (SELECT doc_id AS chunk_ord, lang AS kb, CASE WHEN lang = 'es' THEN n ELSE text END AS text FROM
(SELECT *, lead(text) OVER (ORDER BY doc_id) AS n FROM documents) WHERE lang IS DISTINCT FROM 'de' UNION ALL SELECT item_id, 'bench', text FROM benchmark)"""


@query("index_stores", f"WITH {bm25_sql('kb').replace(CHUNKS, CHANGED)} SELECT kb, chunk_ord, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0")
def _(spark, sf):
    root = folder(spark, "index")
    d = texts_of(spark, sf)
    index.create(d, root)
    following = scan.prefix(d, [], [F.col("chunk_ord").desc()], lags={"next": "text"}).filter("kb = 'es'")
    fresh = following.select("chunk_ord", "kb", F.col("next").alias("text"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_ord"), F.lit("bench").alias("kb"), "text")
    index.upsert(spark, root, fresh.unionByName(items))
    index.apply(spark, root, removed=d.filter("kb = 'de'"))
    return index.scores(spark, root, QUESTION, ["kb"]).select("kb", "chunk_ord", F.round("bm25", 6).alias("bm25"))


@query("logstore_upsert", """WITH h AS (SELECT source AS src, doc_id FROM documents), i AS (SELECT source AS src, doc_id FROM documents WHERE lang <> 'de' OR source < 'src2'),
f AS (SELECT src FROM (SELECT src, count(*) AS n FROM i GROUP BY 1) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT src, count(*) AS n FROM h GROUP BY 1) b WHERE b.src = a.src AND b.n = a.n))
SELECT src, doc_id FROM (SELECT src, doc_id FROM h WHERE src NOT IN (SELECT src FROM f) UNION ALL SELECT src, doc_id FROM i WHERE src IN (SELECT src FROM f)) WHERE src <> 'src4'""")
def _(spark, sf):
    root = folder(spark, "logstore")
    d = table(spark, sf, "documents").select(F.col("source").alias("src"), "doc_id", "lang", "text")
    logstore.create(spark, root, d.schema, fanout=2)
    logstore.upsert(spark, root, d)
    logstore.upsert(spark, root, d.filter("lang <> 'de' OR src < 'src2'"))
    logstore.delete(spark, root, d.filter("src = 'src4'").select("src").distinct())
    return logstore.read(spark, root).select("src", "doc_id")


@query("ranges_timeline", "SELECT event_id AS idx, round(coalesce(sum(value + 0.4) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_at FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("idx"), "value")
    return package.timeline(e, [], "idx", "value").select("idx", F.round("start_at", 4).alias("start_at"))


@query("ranges_asof", f"WITH {PLAY}, q AS (SELECT event_id, user_id, CAST(event_id % 97 AS DOUBLE) + 0.05 AS start_at FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, idx, round(start_at, 6) AS start_at FROM pl) SELECT q.event_id, max(p.idx) AS idx FROM q LEFT JOIN p ON p.user_id = q.user_id AND p.start_at <= q.start_at GROUP BY q.event_id")
def _(spark, sf):
    e = table(spark, sf, "events")
    played = package.timeline(e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("idx"), F.col("value").alias("dur")), ["user_id"], "idx", "dur", split=True)
    asked = e.filter("event_type = 'purchase'").select("event_id", "user_id", ((F.col("event_id") % 97).cast("double") + 0.05).alias("start_at"))
    marks = played.select("user_id", F.round("start_at", 6).alias("start_at"), "idx")
    return scan.asof(asked, marks, ["user_id"], "start_at", "idx").select("event_id", "idx")


@query("ranges_newest", "SELECT event_type AS kind, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50")
def _(spark, sf):
    return scan.newest(events(spark, sf), ["kind"], [F.col("ts").desc(), F.col("id").desc()], 50).select("kind", "id")


@query("ranges_gaps", "SELECT event_id, round(value - lag(value) OVER (ORDER BY ts, event_id), 6) AS step, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id) AS last_error FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    out = scan.prefix(e, [], ["ts", "event_id"], lags={"before": "value"}, lasts={"last_error": F.when(F.col("event_type") == "error", F.col("event_id"))})
    return out.select("event_id", F.round(F.col("value") - F.col("before"), 6).alias("step"), "last_error")


@query("near_pairs_pruned", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.4""")
def _(spark, sf):
    v = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_ord")
    return near.pairs(v, 0.4).select("a", "b", F.round("sim", 6).alias("sim"))


#: Exact dedup, the greedy rule over what it leaves, row by row, then short texts out.
REBUILT = f"""WITH RECURSIVE {CHUNKS}, {EXACT}, v AS (SELECT e.chunk_ord, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (ORDER BY e.chunk_ord) AS i FROM e JOIN chunks USING (chunk_ord) WHERE embedding IS NOT NULL),
nb AS (SELECT b.i, list(a.i) FILTER (a.i IS NOT NULL) AS l FROM v b LEFT JOIN v a ON a.i < b.i AND list_cosine_similarity(a.x, b.x) > 0.35 GROUP BY 1),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT r.i + 1, CASE WHEN list_has_any(coalesce(nb.l, []), kept) THEN kept ELSE list_append(kept, r.i + 1) END FROM r JOIN nb ON nb.i = r.i + 1),
s AS (SELECT unnest(kept) AS i FROM r WHERE i = (SELECT max(i) FROM v))
SELECT e.chunk_ord FROM e JOIN chunks USING (chunk_ord) LEFT JOIN v USING (chunk_ord) WHERE (v.i IS NULL OR v.i IN (SELECT i FROM s)) AND length(trim(chunks.text, {WS})) >= 8"""


@query("rebuild_near", REBUILT)
def _(spark, sf):
    return C.rebuild(chunks(spark, sf), 0.35).select("chunk_ord")


# Embeddings are kept: the second pass over all documents sends only what the first, over some languages, has not sent. --------


@query("reindex_memo", """WITH t AS (SELECT text, lang FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288)) <> ''), s AS (SELECT count(DISTINCT text) AS n FROM t),
k AS (SELECT count(DISTINCT text) AS n FROM t WHERE lang <> 'de') SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM t) AS wanted, s.n AS texts, k.n AS known, s.n - k.n AS embedded, 0 AS failed FROM s, k""")
def _(spark, sf):
    root, provider = folder(spark, "memo"), memo.hashed_tokens()
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_ord"), "lang", "text")
    memo.reindex(d.filter("lang <> 'de'"), root, "hashed", provider)
    return memo.reindex(d, root, "hashed", provider)[1]


@query("sql_chunk", CHUNKED)
def _(spark, sf):
    tables.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("loam_documents")
    return spark.sql("SELECT doc_id, c.* FROM loam_documents, LATERAL chunk(text) AS c")


def diff_documents(spark, sf):
    """Each document against the next: no SQL, tests hold the scripts against dynamic programming."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    following = scan.prefix(d, [], [F.col("doc_id").desc()], lags={"next": "text"})
    return tables.diffs(following, "text", "next").select("doc_id", "hunk", "old_start", "old_lines", "new_start", "new_lines", "ratio")


Q["diff_documents"] = diff_documents


#: Characters of pages after which an archive is closed.
ARCHIVE_CHARS = 1 << 24


# Pages packed into archives and events written as a log, by Spark, are read by the library's own sources. -----------------------


@query("zip_members", "SELECT page_id, md5(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS size FROM pages")
def _(spark, sf):
    root = folder(spark, "archives")

    def pack(batches):
        import io
        import itertools
        import uuid
        import zipfile

        import pyarrow as pa

        from loam.sources import remote

        def archive(pages):
            """The name of an archive of the next pages, as far as it goes."""
            raw, size = io.BytesIO(), 0
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                for i, html in pages:
                    html = html.as_py() or ""
                    z.writestr(f"pages/{i}.html", html)
                    size += len(html)
                    if size >= ARCHIVE_CHARS:
                        break
            name = f"{root}/{uuid.uuid4().hex}.zip"
            remote.put(name, raw.getbuffer())
            return name

        pages = ((i, html) for batch in batches for i, html in zip(batch.column(0), batch.column(1)))
        for first in pages:
            yield pa.RecordBatch.from_pydict({"name": [archive(itertools.chain([first], pages))]})

    # The names are written, so that what a task leaves that is run again is not read.
    names = [r.name for r in written(table(spark, sf, "pages").select("page_id", "html").mapInArrow(pack, "name string"), "archive-names").collect()]  # one for some ARCHIVE_CHARS of pages, or a task
    readers.register(spark)
    rows = spark.read.format("zip_members").option("archives", "\n".join(names)).load(root)
    return rows.select(F.regexp_extract("member", r"(\d+)", 1).cast("long").alias("page_id"), F.md5("content").alias("digest"), "size")


@query("jsonl_tail", "SELECT event_id AS id, user_id FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 50")
def _(spark, sf):
    root = folder(spark, "log")
    log = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("kind"))
    log.repartitionByRange("event_id").sortWithinPartitions("event_id").write.json(root)
    readers.register(spark)
    ends = spark.read.format("jsonl_tail").option("limit", 50).option("kind", "view").load(root)
    held = ends.select(F.from_json("value", "event_id long, user_id long").alias("r")).select(F.col("r.event_id").alias("id"), "r.user_id")
    return held.orderBy(F.col("id").desc()).limit(50)


#: The graph of all documents but those of one source, which leave after the others have come in two batches.
LEFT = EDGES.replace("FROM documents)", "FROM documents WHERE source IS DISTINCT FROM 'src3')")


@query("graph_upserts", f"WITH {LEFT} SELECT a, b, w FROM ed")
def _(spark, sf):
    root = folder(spark, "graph")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_ord"), "lang", "source", F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    d = d.filter(F.char_length("term").between(9, 12))
    graphstore.create(spark, root)
    graphstore.apply(spark, root, d.filter("lang <> 'de'").select("chunk_ord", "term"))
    rest = d.filter("lang = 'de' OR lang = 'fr' OR lang IS NULL").select("chunk_ord", "term")
    graphstore.apply(spark, root, rest, table(spark, sf, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("chunk_ord")))
    # What came and was removed in one batch has come: it leaves with the next.
    graphstore.apply(spark, root, removed=table(spark, sf, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("chunk_ord")))
    return graphstore.edges(spark, root, 3)


@query("search_early", f"WITH {CHUNKS} SELECT chunk_ord, source FROM chunks WHERE contains(text, 'tion') ORDER BY chunk_ord LIMIT 50")
def _(spark, sf):
    root = folder(spark, "ordered")
    ordered.write(chunks(spark, sf).select("chunk_ord", "source", "text"), root, "chunk_ord")
    return ordered.first(spark, root, F.contains("text", F.lit("tion")), 50)[0].select("chunk_ord", "source")
