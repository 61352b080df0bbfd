"""Queries of search, scoring and context building over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import chunking as C
from loam.operators import retrieval as R

QUESTION = "the and tion le der que reti 12"
QUERY_VEC = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def spread(rows: DataFrame) -> DataFrame:
    """Texts of a small file, whose one row group one task would read, dealt to all cores; tables of more splits than
    cores stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks, a store for each language, with the vector of the same number where there is one."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ord"), F.col("lang").alias("kb"), "source", "text")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_ord"), "embedding")
    return d.join(e, "chunk_ord", "left")


def query_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_VEC).select(F.col("embedding").alias("qv"))


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


WORDS = list(dict.fromkeys(QUESTION.split()))
CHUNKS = "chunks AS (SELECT d.doc_id AS chunk_ord, d.lang AS kb, d.source, d.text, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"
# Patterns of the oracles, written apart from those of the library.
WORD = r"[0-9a-z]+|[\x{4E00}-\x{9FFF}]"
TOK = f"regexp_extract_all(lower(text), '{WORD}')"


def bm25_sql(by: str = "") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(WORDS))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(WORDS)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0.0 END" for i in range(len(WORDS)))
    on = f"ON f.{by} = s.g" if by else "ON true"
    g = f"{by} AS g" if by else "1 AS g"
    return f"""{CHUNKS}, tk AS (SELECT *, {TOK} AS t FROM chunks), f AS (SELECT *, len(t) AS dl, {tf} FROM tk),
s AS (SELECT {g}, count(*) AS n, avg(dl) AS avgdl, {df} FROM f {"GROUP BY " + by if by else ""}),
b AS (SELECT f.*, {score} AS bm25 FROM f JOIN s {on})"""


def fused_sql(by: str = "") -> str:
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return bm25_sql(by) + f""", m AS (SELECT *, CASE WHEN max(bm25) {over} = min(bm25) {over} THEN 0.0 ELSE (bm25 - min(bm25) {over}) / (max(bm25) {over} - min(bm25) {over}) END AS norm FROM b),
v AS (SELECT m.*, CASE WHEN m.embedding IS NULL THEN 0.0 ELSE greatest(0.0, list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) END AS vec
      FROM m CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VEC}) q),
u AS (SELECT *, 0.6 * vec + 0.4 * norm AS score FROM v)"""


@query("tokenize", f"SELECT doc_id, len(t)::INT AS n, len(list_distinct(t))::INT AS kinds, md5(array_to_string(t, ',')) AS digest FROM (SELECT doc_id, {TOK} AS t FROM documents)")
def _(spark, sf):
    t = T.tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("kinds"), F.md5(F.array_join(t, ",").cast("binary")).alias("digest"))


@query("token_estimates", rf"""SELECT doc_id, CAST(floor(zh + 1.3 * len(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS BIGINT) AS est,
CAST(floor(zh / 1.6 + (length(text) - zh) / 4.0) + 1 AS BIGINT) AS trace_est FROM (SELECT doc_id, text, length(text) - length(regexp_replace(text, '[\x{{4E00}}-\x{{9FFF}}]', '', 'g')) AS zh FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.est_tokens("text").alias("est"), T.trace_tokens("text").alias("trace_est"))


@query("fingerprints", "SELECT doc_id, md5(left(text, 400)) AS fp_answer, left(sha1(left(text, 160)), 12) AS fp_graph, left(sha1(text), 16) AS fp_carry, sha256(text) AS fp_file FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in T.fingerprints("text").items()])


@query("detect_lang", """SELECT doc_id, CASE WHEN s = '' OR zh > 2 * la THEN 'zh' WHEN la > 2 * zh THEN 'en' ELSE 'en,zh' END AS langs, CASE WHEN letters > zh_all AND letters > 3 THEN '英文' ELSE '中文' END AS ui
FROM (SELECT doc_id, left(text, 4096) AS s, length(left(text, 4096)) - length(regexp_replace(left(text, 4096), '[一-鿿]', '', 'g')) AS zh, length(left(text, 4096)) - length(regexp_replace(left(text, 4096), '[A-Za-z]', '', 'g')) AS la,
length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS zh_all FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.detect_langs("text"), ",").alias("langs"), T.ui_lang("text").alias("ui"))


@query("sentences", r"""SELECT doc_id, pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s)))::INT AS pos FROM
(SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> '') AS s FROM documents))""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


@query("vector_topk", f"""SELECT e.vec_id AS chunk_ord, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS vec FROM embeddings e
CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VEC}) q ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, 1 LIMIT 10""")
def _(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_ord"), "embedding")
    return R.vector_topk(v, query_vec(spark, sf), 10).select("chunk_ord", F.round("vec", 6).alias("vec"))


@query("bm25_scores", f"WITH {bm25_sql()} SELECT chunk_ord, round(bm25, 6) AS bm25 FROM b")
def _(spark, sf):
    return R.bm25(chunks(spark, sf), QUESTION).select("chunk_ord", F.round("bm25", 6).alias("bm25"))


@query("bm25_minmax", f"WITH {fused_sql()} SELECT chunk_ord, round(norm, 6) AS norm FROM u")
def _(spark, sf):
    return R.minmax(R.bm25(chunks(spark, sf), QUESTION)).select("chunk_ord", F.round("norm", 6).alias("norm"))


@query("hybrid_topk", f"WITH {fused_sql()} SELECT chunk_ord, source, round(bm25, 6) AS bm25, round(vec, 6) AS vec, round(score, 6) AS score FROM u ORDER BY u.score DESC, chunk_ord LIMIT 20")
def hybrid(spark, sf):
    hits = R.hybrid_topk(chunks(spark, sf), QUESTION, query_vec(spark, sf), 20)
    return hits.select("chunk_ord", "source", F.round("bm25", 6).alias("bm25"), F.round("vec", 6).alias("vec"), F.round("score", 6).alias("score"))


@query("hybrid_threshold", f"WITH {fused_sql()} SELECT chunk_ord, round(norm, 6) AS norm, round(score, 6) AS score FROM u WHERE vec >= 0.2")
def _(spark, sf):
    return R.fused(chunks(spark, sf), QUESTION, query_vec(spark, sf), threshold=0.2).select("chunk_ord", F.round("norm", 6).alias("norm"), F.round("score", 6).alias("score"))


MULTI = f"""{fused_sql("kb")}, k AS (SELECT *, row_number() OVER (PARTITION BY kb ORDER BY score DESC, chunk_ord) AS r FROM u),
z AS (SELECT kb, chunk_ord, r, CASE WHEN kb = 'en' THEN round(score, 4) ELSE round(round(score, 4) * 1.15, 4) END AS score FROM k WHERE r <= 5)"""


@query("multi_scope_topk", f"WITH {MULTI} SELECT kb, chunk_ord, score FROM z ORDER BY z.score DESC, kb, r LIMIT 5")
def _(spark, sf):
    return R.multi_scope_topk(chunks(spark, sf), QUESTION, query_vec(spark, sf), 5, public="en").select("kb", "chunk_ord", "score")


def hits_of(spark, sf, n: int = 12) -> DataFrame:
    """Results of one search: the documents of the most distinct question words, by ord."""
    toks = T.tokens("text")
    hit = F.size(F.array_intersect(F.array_distinct(toks), F.array(*[F.lit(w) for w in WORDS])))
    best = table(spark, sf, "documents").select("doc_id", "source", "text", hit.alias("hit")).orderBy(F.col("hit").desc(), "doc_id").limit(n)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.col("hit").desc(), "doc_id"))
    return best.select(rank.alias("ord"), "doc_id", F.col("source").alias("label"), "text", (F.col("hit") / len(WORDS)).alias("score"))


IN_Q = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
HITS = f"""h0 AS (SELECT doc_id, source AS label, text, len(list_intersect(list_distinct({TOK}), {IN_Q})) AS hit FROM documents),
h1 AS (SELECT *, row_number() OVER (ORDER BY hit DESC, doc_id) AS ord FROM h0), hits AS (SELECT ord, doc_id, label, text, hit / {len(WORDS)}.0 AS score FROM h1 WHERE ord <= 12)"""
SENT = rf"""{HITS}, s0 AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> '') AS ss FROM hits),
s1 AS (SELECT ord, doc_id, label, score, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM s0),
s2 AS (SELECT *, list_distinct(regexp_extract_all(lower(sentence), '{WORD}')) AS uq FROM s1),
s3 AS (SELECT *, len(list_intersect(uq, {IN_Q})) AS hit FROM s2),
s4 AS (SELECT *, CASE WHEN len(uq) = 0 THEN 0.0 ELSE (0.7 * hit / len(uq) + 0.3 * least(1.0, hit / 4.0)) * (CASE WHEN length(sentence) <= 80 THEN 1.0 ELSE greatest(0.5, 80.0 / length(sentence)) END) * (0.6 + 0.8 * score) END AS s_score FROM s3)"""


@query("sentence_scores", f"WITH {SENT} SELECT ord::INT AS ord, pos::INT AS pos, round(s_score, 6) AS s_score FROM s4")
def _(spark, sf):
    return R.sentence_scores(hits_of(spark, sf), QUESTION).select("ord", "pos", F.round("s_score", 6).alias("s_score"))


@query("compress_context", f"""WITH {SENT}, c0 AS (SELECT *, row_number() OVER (ORDER BY round(s_score, 9) DESC, ord, pos) AS r, left(sentence, 40) AS k FROM s4 WHERE length(sentence) >= 6 AND s_score > 0),
c1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) = 1 AS first FROM c0),
c2 AS (SELECT *, coalesce(sum(CASE WHEN first THEN length(sentence) ELSE 0 END) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(sentence) > 600 AS over FROM c1),
c3 AS (SELECT *, max(over::INT) OVER (ORDER BY r) AS stop FROM c2), c4 AS (SELECT *, min(r) OVER (PARTITION BY label) AS g FROM c3 WHERE stop = 0 AND first)
SELECT label, ord::INT AS ord, (row_number() OVER (ORDER BY g, r))::INT AS kept, sentence FROM c4""")
def _(spark, sf):
    return R.compress_context(hits_of(spark, sf), QUESTION, 300)


BLOCKS = "bl AS (SELECT lang, source, doc_id, text, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank FROM documents)"


def ranked_docs(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    r = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    return d.select("lang", "source", "doc_id", F.col("source").alias("label"), F.lit("").alias("breadcrumb"), "text", F.concat("lang", F.lit("/"), "source").alias("q"), r.alias("rank"))


@query("build_context", f"""WITH {BLOCKS}, x AS (SELECT lang, source, rank, '【' || source || '】' || chr(10) || text AS block FROM bl),
y AS (SELECT *, sum(length(block)) OVER (PARTITION BY lang, source ORDER BY rank) AS s FROM x) SELECT lang, source, rank::INT AS rank, block FROM y WHERE s <= 6000""")
def _(spark, sf):
    return R.build_context(ranked_docs(spark, sf), ["lang", "source"])


@query("corpus_cut", f"""WITH {BLOCKS}, y AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY lang, source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM bl) SELECT lang, source, doc_id FROM y WHERE s <= 40000""")
def _(spark, sf):
    return R.include_then_stop(ranked_docs(spark, sf), ["lang", "source"], ["rank"], F.char_length("text"), 40000).select("lang", "source", "doc_id")


@query("export_context", f"""WITH {BLOCKS}, x AS (SELECT lang || '/' || source AS q, left(string_agg(left(text, 1600), chr(10) || chr(10) ORDER BY rank), 9000) AS c FROM bl WHERE rank <= 10 GROUP BY 1) SELECT q, CASE WHEN length(c) >= 80 THEN c END AS context FROM x""")
def _(spark, sf):
    return R.export_context(ranked_docs(spark, sf), "q")


@query("retrieve_multi", """WITH h AS (SELECT doc_id, text, length(text) - length(replace(text, w, '')) AS score, q_ord FROM documents CROSS JOIN (VALUES (0, 'the'), (1, 'tion'), (2, 'que')) v(q_ord, w)),
r AS (SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY score DESC, doc_id) AS rank FROM h), k AS (SELECT * FROM r WHERE rank <= 12),
f AS (SELECT *, row_number() OVER (PARTITION BY md5(left(text, 400)) ORDER BY q_ord, rank) AS x FROM k) SELECT q_ord, rank::INT AS rank, doc_id, score::INT AS score FROM f WHERE x = 1 ORDER BY f.score DESC, q_ord, f.rank LIMIT 12""")
def _(spark, sf):
    from functools import reduce

    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    best = []
    for i, w in enumerate(("the", "tion", "que")):
        score = F.char_length("text") - F.char_length(F.replace("text", F.lit(w), F.lit("")))
        top = d.select(F.lit(i).alias("q_ord"), "doc_id", "text", score.alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(12)
        best.append(top.withColumn("rank", F.row_number().over(Window.partitionBy("q_ord").orderBy(F.col("score").desc(), "doc_id"))))
    return R.retrieve_multi(reduce(DataFrame.unionByName, best)).select("q_ord", "rank", "doc_id", "score")


PROFILE = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
f AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) LIKE '```%' AS fence FROM l), g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM f),
b AS (SELECT *, regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$') AND regexp_matches(line, '[A-Za-z一-鿿]') AS head FROM g WHERE NOT fence AND NOT inside),
p AS (SELECT doc_id, avg(length(line)) AS avg_len, stddev_pop(length(line)) AS std_len, count(*) FILTER (head) AS headings,
 count(*) FILTER (NOT head AND regexp_matches(line, '^[ \t]*(\d+(\.\d+){{1,3}}\.?|\d+\.|[IVX]{{1,5}}\.)[ \t]+\S.{{0,200}}$')) AS numbered, count(*) FILTER (NOT head AND regexp_matches(line, '^[ \t]*[A-ZÄÖÜ][A-ZÄÖÜ \-]{{3,80}}:?\s*$')) AS all_caps,
 count(*) FILTER (NOT head AND regexp_matches(line, '^[ \t]*(---+|===+|\*\*\*+|___+)[ \t]*$')) AS separators, count(*) FILTER (NOT head AND regexp_matches(line, '^[ \t]*([Ss][Ee][Ii][Tt][Ee]|[Pp][Aa][Gg][Ee]|页|页码)\s+\d+(\s*([Vv][Oo][Nn]|[Oo][Ff]|/)\s*\d+)?[ \t]*$')) AS footers,
 count(*) FILTER (NOT head AND regexp_matches(line, '^[ \t]*(Chapter|Section|Part)\s+([0-9]+|[IVX]{{1,5}})[.: ].{{0,200}}$')) AS chapters_en, count(*) FILTER (NOT head AND regexp_matches(line, '^[ \t]*(Kapitel|Abschnitt|Teil)\s+([0-9]+|[IVX]{{1,5}})[.: ].{{0,200}}$')) AS chapters_de,
 bool_or(NOT head AND regexp_matches(line, '^[ \t]*\|.*\|[ \t]*$')) AS has_tables FROM b GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS total_lines, count(*) FILTER (fence) AS fences FROM f GROUP BY doc_id)"""


@query("doc_profile", rf"""WITH {PROFILE} SELECT d.doc_id, length(text)::INT AS total_chars, total_lines::INT AS total_lines, round(avg_len, 6) AS avg_line_len, round(std_len, 6) AS std_line_len, headings::INT AS headings, numbered::INT AS numbered,
all_caps::INT AS all_caps, separators::INT AS separators, footers::INT AS footers, has_tables, fences > 0 AS has_code, len(regexp_extract_all(text, '\n\n\n+'))::INT AS blank_breaks FROM documents d JOIN p USING (doc_id) JOIN t USING (doc_id)""")
def _(spark, sf):
    p = C.doc_profile(table(spark, sf, "documents"))
    return p.select("doc_id", "total_chars", "total_lines", F.round("avg_line_len", 6).alias("avg_line_len"), F.round("std_line_len", 6).alias("std_line_len"), "headings", "numbered", "all_caps", "separators", "footers", "has_tables", "has_code", "blank_breaks")


@query("chunk_strategy", rf"""WITH {PROFILE} SELECT doc_id, CASE WHEN numbered + all_caps + separators + chapters_en + chapters_de >= 5 OR chapters_en + chapters_de > 0 THEN 'heuristic,recursive' ELSE 'recursive' END AS chain FROM p""")
def _(spark, sf):
    return C.chunk_strategy(C.doc_profile(table(spark, sf, "documents"))).select("doc_id", F.array_join("chain", ",").alias("chain"))
