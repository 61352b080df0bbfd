"""Search and context building over chunk tables.

A chunk table has chunk_ord (the order that breaks ties) and text, and may have kb, breadcrumb, source and embedding.
Statistics of a whole store are one-row (or one-row-per-kb) aggregates joined back by broadcast; the query's tokens are
counted within each row, so no posting list is shuffled and BM25 costs one pass for statistics and one for scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T

K1, B = 1.5, 0.75
ALPHA, TOP_K = 0.6, 5
PRIVATE_BOOST = 1.15
CONTEXT_CHARS = 6000


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b, norm_b=None):
    """0 for a null or zero vector; the longer vector is cut to the shorter. norm_b: b's length, where it is known."""
    norm = F.sqrt(dot(a, a)) * (F.sqrt(dot(b, b)) if norm_b is None else norm_b)
    return F.when(a.isNull() | b.isNull() | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def _beside(chunks: DataFrame, query: DataFrame) -> tuple[DataFrame, Column, list[str]]:
    """chunks beside the query's one row, their cosine to its qv, and the columns to be dropped after it."""
    v, n = T.spare(chunks, "_qv"), T.spare(chunks, "_qn")
    row = query.limit(1).select(F.col("qv").alias(v), F.sqrt(dot(F.col("qv"), F.col("qv"))).alias(n))
    return chunks.crossJoin(F.broadcast(row)), cosine(F.col("embedding"), F.col(v), F.col(n)), [v, n]


def vector_topk(chunks: DataFrame, query: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k chunks of highest cosine to the one row of query (qv)."""
    rows, likeness, extra = _beside(chunks.filter(F.col("embedding").isNotNull()), query)
    return rows.withColumn("vec", likeness).drop(*extra).orderBy(F.col("vec").desc(), "chunk_ord").limit(k)


def _counted(chunks: DataFrame, question: str) -> tuple[DataFrame, str, str]:
    """chunks with their length in tokens and how often each of the question's words occurs, and the names of both columns."""
    words = list(dict.fromkeys(_tokens(question)))
    text = F.lower(T.embed_text("text", "breadcrumb") if "breadcrumb" in chunks.columns else F.coalesce("text", F.lit("")))
    # The question's tokens are picked by a pattern of their own, so the counts below run over a handful of them.
    ascii_, cjk = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    parts = [rf"(?<![a-z0-9])(?:{'|'.join(ascii_)})(?![a-z0-9])"] * bool(ascii_) + [f"[{''.join(cjk)}]"] * bool(cjk)
    hits = F.regexp_extract_all(text, F.lit("|".join(parts)), F.lit(0)) if parts else F.array().cast("array<string>")
    h, dl, tf = (T.spare(chunks, c) for c in ("_h", "_dl", "_tf"))
    times_in = lambda w: F.size(F.filter(h, lambda x: x == w))
    tfs = F.array(*[times_in(w) for w in words]) if words else F.array().cast("array<int>")
    return chunks.withColumn(h, hits).withColumn(dl, F.size(T.tokens(text))).withColumn(tf, tfs).drop(h), dl, tf


def _scored(rows: DataFrame, counts: DataFrame, question: str, by: list[str], dl: str, tf: str) -> DataFrame:
    """rows with bm25, by statistics of counts: chunks of equal length and counts as one row each, weighted by _m."""
    words = list(dict.fromkeys(_tokens(question)))
    n_, avg, dfs = (T.spare(rows, c) for c in ("_n", "_avg", "_df"))
    m = F.col("_m")
    df = F.array(*[F.sum(F.when(F.col(tf)[i] > 0, m).otherwise(0)) for i in range(len(words))])
    stats = counts.groupBy(*by).agg(F.sum(m).alias(n_), (F.sum(F.col(dl) * m) / F.sum(m)).alias(avg), df.alias(dfs))
    # One row, or one a store: of stores there may be many, so their join is left to the planner.
    joined = _by_store(rows, stats, by)
    score = F.lit(0.0)
    for i, w in enumerate(words):
        idf = F.log(1 + (F.col(n_) - F.col(dfs)[i] + 0.5) / (F.col(dfs)[i] + 0.5))
        f = F.col(tf)[i]
        score = score + F.when(f > 0, _tokens(question).count(w) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(dl) / F.col(avg)))).otherwise(0.0)
    return joined.withColumn("bm25", score).drop(n_, avg, dfs)


def _by_store(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """rows beside the one row of stats, or beside that of their store: a null store is a store."""
    if not by:
        return rows.crossJoin(F.broadcast(stats))
    keys = {c: T.spare(rows, f"_{c}_of") for c in by}
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return rows.join(stats.withColumnsRenamed(keys), same).drop(*keys.values())


def _kinds(counted: DataFrame, by: list[str], dl: str, tf: str) -> DataFrame:
    # The filter drops nothing: it keeps the count in the plan of those who don't need it, so that all use one exchange.
    return counted.groupBy(*by, dl, tf).agg(F.count("*").alias("_m")).filter("_m > 0")


def bm25(chunks: DataFrame, question: str, by: list[str] | None = None) -> DataFrame:
    """chunks with bm25, by store where `by` names the columns of a store. All chunks count, those without tokens too."""
    by = by or []
    counted, dl, tf = _counted(chunks, question)
    return _scored(counted, _kinds(counted, by, dl, tf), question, by, dl, tf).drop(dl, tf)


def bm25_scaled(chunks: DataFrame, question: str, by: list[str] | None = None) -> DataFrame:
    """bm25 and norm, as minmax(bm25(...)) gives them. Chunks of equal length and counts score alike, so one table of those
    kinds, which holds only numbers, gives both the statistics and the ends; texts are tokenised for it and for the scores."""
    by = by or []
    counted, dl, tf = _counted(chunks, question)
    kinds = _kinds(counted, by, dl, tf)
    lo, hi = T.spare(counted, "_lo"), T.spare(counted, "_hi")
    ends = _scored(kinds, kinds, question, by, dl, tf).groupBy(*by).agg(F.min("bm25").alias(lo), F.max("bm25").alias(hi))
    return _scale(_scored(counted, kinds, question, by, dl, tf).drop(dl, tf), ends, "bm25", by, lo, hi)


def _tokens(question: str) -> list[str]:
    import re

    return re.findall(T.TOKEN, question.lower())


def minmax(scored: DataFrame, column: str = "bm25", by: list[str] | None = None) -> DataFrame:
    """scored with norm, the column scaled to 0..1 over the whole store; 0 where all are equal."""
    by = by or []
    lo, hi = T.spare(scored, "_lo"), T.spare(scored, "_hi")
    return _scale(scored, scored.groupBy(*by).agg(F.min(column).alias(lo), F.max(column).alias(hi)), column, by, lo, hi)


def _scale(scored: DataFrame, ends: DataFrame, column: str, by: list[str], lo: str, hi: str) -> DataFrame:
    joined = _by_store(scored, ends, by)
    norm = F.when(F.col(hi) == F.col(lo), 0.0).otherwise((F.col(column) - F.col(lo)) / (F.col(hi) - F.col(lo)))
    return joined.withColumn("norm", norm).drop(lo, hi)


def fused(chunks: DataFrame, question: str, query: DataFrame, alpha: float = ALPHA, threshold: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """chunks with bm25, norm, vec (cosine, at least 0) and score; the vector threshold comes after the scaling."""
    rows, likeness, extra = _beside(bm25_scaled(chunks, question, by), query)
    scored = rows.withColumn("vec", F.greatest(F.lit(0.0), likeness)).drop(*extra)
    if threshold > 0:
        scored = scored.filter(F.col("vec") >= threshold)
    return scored.withColumn("score", alpha * F.col("vec") + (1 - alpha) * F.col("norm"))


def hybrid_topk(chunks: DataFrame, question: str, query: DataFrame, k: int = TOP_K, alpha: float = ALPHA, threshold: float = 0.0) -> DataFrame:
    return fused(chunks, question, query, alpha, threshold).orderBy(F.col("score").desc(), "chunk_ord").limit(k)


def multi_scope_topk(chunks: DataFrame, question: str, query: DataFrame, k: int = TOP_K, public: str = "public", alpha: float = ALPHA) -> DataFrame:
    """Each store of column kb has its own statistics and k hits; private hits are raised, then the k best of all."""
    scored = fused(chunks, question, query, alpha, by=["kb"])
    w = Window.partitionBy("kb").orderBy(F.col("score").desc(), "chunk_ord")
    r = T.spare(scored, "_r")
    own = scored.withColumn(r, F.row_number().over(w)).filter(F.col(r) <= k).withColumn("score", F.round("score", 4))
    boosted = own.withColumn("score", F.when(F.col("kb") == public, F.col("score")).otherwise(F.round(F.col("score") * PRIVATE_BOOST, 4)))
    return boosted.orderBy(F.col("score").desc(), "kb", r).limit(k).drop(r)


def retrieve_multi(hits: DataFrame, most: int = 12) -> DataFrame:
    """hits of several questions (q_ord, rank, text, score): first of equal text beginnings, then the best `most`."""
    fp = F.md5(F.substring("text", 1, 400).cast("binary"))
    w = Window.partitionBy(fp).orderBy("q_ord", "rank")
    r = T.spare(hits, "_r")
    return hits.withColumn(r, F.row_number().over(w)).filter(F.col(r) == 1).drop(r).orderBy(F.col("score").desc(), "q_ord", "rank").limit(most)


def sentence_scores(hits: DataFrame, question: str) -> DataFrame:
    """hits (ord, text, score) cut into sentences: pos, sentence, s_score, which replace columns of those names."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(_tokens(question)) if t not in T.STOP_CHARS]).cast("array<string>")
    rows = hits.drop("pos", "sentence", "s_score").select("*", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    uniq = F.array_distinct(T.tokens("sentence"))
    hit = F.size(F.array_intersect(uniq, q))
    n = F.char_length("sentence")
    factor = F.when(n <= 80, 1.0).otherwise(F.greatest(F.lit(0.5), 80.0 / n))
    score = (0.7 * hit / F.greatest(F.lit(1), F.size(uniq)) + 0.3 * F.least(F.lit(1.0), hit / 4.0)) * factor * (0.6 + 0.8 * F.coalesce(F.col("score"), F.lit(0.0)))
    return rows.withColumn("s_score", F.when(F.size(uniq) == 0, 0.0).otherwise(score))


def compress_context(hits: DataFrame, question: str, max_tokens: int = 1200) -> DataFrame:
    """The sentences that a compressed context keeps: label, ord, kept, sentence, in the order they are shown.

    hits are one retrieval's results (ord, text, score, label), a dozen or so, hence the windows without partitions.
    Sentences go by score; under 6 characters or of no score are dropped; the first that would overrun the budget ends
    it, counted before repeats (of the first 40 characters) are dropped; labels come in the order of their first sentence.
    """
    rows = sentence_scores(hits.select("ord", "text", "score", "label"), question).filter((F.char_length("sentence") >= 6) & (F.col("s_score") > 0))
    order = Window.orderBy(F.col("s_score").desc(), "ord", "pos")
    rows = rows.withColumn("_r", F.row_number().over(order)).withColumn("_k", F.substring("sentence", 1, 40))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("_k").orderBy("_r")) == 1)
    n = F.char_length("sentence")
    used = F.coalesce(F.sum(F.when(F.col("_first"), n).otherwise(0)).over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_over", used + n > 2 * max_tokens)
    rows = rows.withColumn("_stop", F.max("_over").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("_stop") & F.col("_first"))
    rows = rows.withColumn("_group", F.min("_r").over(Window.partitionBy("label")))
    return rows.select("label", "ord", F.row_number().over(Window.orderBy("_group", "_r")).alias("kept"), "sentence")


def build_context(hits: DataFrame, by: list[str], limit: int = CONTEXT_CHARS) -> DataFrame:
    """Blocks of ranked hits (rank, label, breadcrumb, text) until the first that would overrun the limit."""
    head = F.concat(F.lit("【"), F.when(F.coalesce(F.col("breadcrumb"), F.lit("")) == "", F.col("label")).otherwise(F.concat("breadcrumb", F.lit(" · "), "label")), F.lit("】\n"))
    w = Window.partitionBy(*by).orderBy("rank")
    rows = hits.select(*by, "rank", F.concat(head, "text").alias("block"))
    # Lengths are positive, so the running sum passes the limit once and for all.
    upto = F.sum(F.char_length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    stop = T.spare(rows, "stop")
    return rows.withColumn(stop, upto > limit).filter(~F.col(stop)).select(*by, "rank", "block")


def include_then_stop(rows: DataFrame, by: list[str], order: list, length, limit: int) -> DataFrame:
    """Keeps rows while what came before is within the limit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = T.spare(rows, "before")
    return rows.withColumn(before, F.coalesce(F.sum(length).over(w), F.lit(0))).filter(F.col(before) <= limit).drop(before)


def budget_skip(rows: DataFrame, by: str, order: str, length: str, limit: int) -> DataFrame:
    """by, kept: the orders kept when rows that don't fit are passed over and later ones still tried; else the first.
    The fold runs on one retrieval's results per row."""
    packed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).alias("n")))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(acc, e):
        fits = acc.used + e.n <= limit
        return F.struct(F.when(fits, acc.used + e.n).otherwise(acc.used).cast("long").alias("used"), F.when(fits, F.concat(acc.kept, F.array(e.o.cast("long")))).otherwise(acc.kept).alias("kept"))

    kept = F.aggregate("x", start, step).kept
    return packed.select(by, F.when(F.size(kept) == 0, F.array(F.col("x")[0].o.cast("long"))).otherwise(kept).alias("kept"))


def export_context(hits: DataFrame, by: str, top: int = 10, each: int = 1600, most: int = 9000, least: int = 80) -> DataFrame:
    """by, context: the first hits, cut and joined; null where less than `least` characters come together."""
    best = hits.filter(F.col("rank") <= top)
    joined = best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, each).alias("t")))), lambda x: x.t), "\n\n").alias("c"))
    cut = F.substring("c", 1, most)
    return joined.select(by, F.when(F.char_length(cut) >= least, cut).alias("context"))


def related_slide(hits: DataFrame, by: str) -> DataFrame:
    """by, page: the slide of the best of the first eight hits that name one; of equal scores the last."""
    page = F.coalesce(F.col("page"), F.nullif(F.regexp_extract("label", r"第\s*(\d+)\s*页", 1), F.lit("")).cast("int"))
    named = hits.filter(F.col("rank") <= 8).select(by, page.alias("p"), F.struct("score", "rank").alias("best"))
    return named.filter("p is not null").groupBy(by).agg(F.max_by("p", "best").alias("page"))


def format_context(hits: DataFrame) -> DataFrame:
    """One row, context: the hits (ord, label, text; as many as a search returns), each under its label, in order. A hit
    without a label is the knowledge base's; no hits give an empty context."""
    block = F.concat(F.lit("["), F.coalesce("label", F.lit("知识库")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    rows = hits.agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), block.alias("block")))).alias("b"))
    return rows.select(F.array_join(F.transform("b", lambda x: x.block), "\n\n").alias("context"))


def expansions(answer, question, most: int = 3):
    """The questions of a model's answer, as an array: a JSON list of strings or of {q}, at most three, blanks and repeats
    out; the question itself where there are none. answer: what json_recover(…, "array") gives."""
    named = F.transform(F.from_json(answer, "array<struct<q:string>>"), lambda x: x.q)
    found = F.when(F.contains(answer, F.lit('{"q"')), named).otherwise(F.from_json(answer, "array<string>"))
    kept = F.slice(F.array_distinct(F.filter(found, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")), 1, most)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(question))
