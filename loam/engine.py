"""Verbs over DataFrames: ingest, ask, rebuild, promote, wiki, statistics. Each composes operators; none holds state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import chunking, corpus, graph, retrieval
from loam.sources import files as S

CHUNK = "kb string, src string, source string, chunk_ord long, breadcrumb string, text string, embedding array<double>"


def ingest(files: DataFrame, kb: str, existing: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, mask: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks of the store after the files were taken in, outcome of each file).

    A source is the sha256 of a file's bytes: files whose source the store holds are skipped before they are read, cut or
    embedded. An edited file is a new source beside the old one."""
    named = files.withColumn("src", F.sha2("content", 256)).dropDuplicates(["src"])
    if existing is not None:
        named = named.join(existing.select("src").distinct(), "src", "left_anti")
    read = S.extract(named).join(named.select("path", "src"), "path")
    docs = read.filter(F.col("error").isNull()).select("src", T.normalize_title(F.element_at(F.split("path", "/"), -1)).alias("source"), T.clean_text("text", mask).alias("text")).filter("text <> ''")
    cut = chunking.exploded(docs, lambda t: chunking.chunks(t, size, overlap), "text string, breadcrumb string", ["text", "breadcrumb"], "src")
    vector = embed(T.embed_text("text", "breadcrumb")) if embed else F.lit(None).cast("array<double>")
    fresh = cut.join(docs.select("src", "source"), "src").select(F.lit(kb).alias("kb"), "src", "source", F.col("chunk_ord").cast("long").alias("chunk_ord"), "breadcrumb", "text", vector.alias("embedding"))
    chunks = fresh if existing is None else existing.unionByName(fresh, allowMissingColumns=True)
    return chunks, read.select("path", "ext", "error")


def ask(chunks: DataFrame, question: str, query: DataFrame, public: str = "public", k: int = retrieval.TOP_K, threshold: float = 0.0, max_tokens: int = 1200) -> dict[str, DataFrame]:
    """hits of all stores of chunks, and the compressed context for a model."""
    hits = retrieval.multi_scope_topk(chunks.filter(F.col("text").isNotNull()), question, query, k, public)
    ranked = hits.select(F.row_number().over(_by_score()).alias("ord"), F.col("source").alias("label"), "text", "score", "kb", "chunk_ord").filter(F.col("score") >= threshold)
    return {"hits": ranked, "context": retrieval.compress_context(ranked, question, max_tokens)}


def _by_score():
    from pyspark.sql import Window

    return Window.orderBy(F.col("score").desc(), "kb", "chunk_ord")  # k rows


def rebuild(chunks: DataFrame, threshold: float = corpus.NEAR) -> tuple[DataFrame, DataFrame]:
    """(the store after exact and near dedup and without short chunks, its statistics before and after)."""
    after = corpus.rebuild(chunks, threshold)
    stats = corpus.kb_stats(chunks).withColumn("when", F.lit("before")).unionByName(corpus.kb_stats(after).withColumn("when", F.lit("after")))
    return after, stats


def entity_graph(chunks: DataFrame, terms: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """nodes, edges and postings of the chunks' entities."""
    crumbs = F.col("breadcrumb") if "breadcrumb" in chunks.columns else F.lit("")
    held = graph.postings(chunks.select("chunk_ord", F.explode(T.entities("text", F.translate(crumbs, "›", ">"), terms)).alias("term")))
    return {"nodes": graph.nodes(held), "edges": graph.edges(held), "postings": held}


def wiki_graph(pages: DataFrame) -> dict[str, DataFrame]:
    """Pages (topic, body, sources) with their links, edges and degrees."""
    linked = pages.select("topic", T.wiki_links("body").alias("links"), "sources")
    edges = graph.wiki_edges(linked)
    return {"edges": edges, "degrees": graph.wiki_degrees(linked, edges)}
