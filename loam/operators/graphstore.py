"""A stored entity graph that follows its chunks: counts of terms and pairs change by signed deltas.

What is held: the mentions of each chunk, in a log of deltas, and three tables of sums, all named by one manifest: how many chunks
mention a term, how many keep it (a chunk keeps its most frequent terms), and how many keep both terms of a pair. A change reads
the mentions of the chunks that come, change or go; and, since a term's count decides which chunks keep it, those of the chunks
of more terms than are kept that mention a term whose count changed. Of these only pairs are made that come or go. All else
stays as it is.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.operators.graph import MAX_ENTITIES, MIN_DF, MIN_WEIGHT, apart
from loam.sources import logstore, versions
from loam.sources.scratch import written

SUMS = {"df": "term string, n long", "kept": "term string, n long", "pairs": "a string, b string, n long"}
#: Parts of a sum after which they are added up into one.
FANOUT = 8


def create(spark: SparkSession, root: str, most: int = MAX_ENTITIES) -> int:
    """An empty graph in the empty folder root; chunks keep their `most` most frequent terms, ties by term."""
    mentions = spark.createDataFrame([], "src string, chunk_ord long, term string").schema
    number = logstore.create(spark, f"{root}/mentions", mentions)
    return versions.commit(spark, root, 0, {"most": most, "mentions": number, "sums": {name: [] for name in SUMS}})


def apply(spark: SparkSession, root: str, mentions: DataFrame | None = None, removed: DataFrame | None = None) -> int:
    """The version in which the chunks of mentions (chunk_ord, term) have these terms and no others, and the chunks of removed
    (chunk_ord) are gone; one that is in both has come. Repeated mentions count once, null terms don't; what isn't held can't be removed."""
    number, m = versions.read(spark, root)
    held = logstore.read(spark, f"{root}/mentions", m["mentions"]).select("chunk_ord", "term")
    none = spark.createDataFrame([], "chunk_ord long, term string")
    new = none if mentions is None else mentions.select(F.col("chunk_ord").cast("long").alias("chunk_ord"), "term").filter("term IS NOT NULL AND chunk_ord IS NOT NULL").distinct()
    new = written(new, "mentions")
    ids = new.select("chunk_ord") if removed is None else new.select("chunk_ord").unionByName(removed.select(F.col("chunk_ord").cast("long").alias("chunk_ord")))
    touched = written(ids.distinct(), "touched")
    old = written(held.join(touched, "chunk_ord", "left_semi"), "mentions")
    df = _sum(spark, root, m, "df")
    d_df = written(_signed([(new.select("term"), 1), (old.select("term"), -1)]), "df")
    # Chunks that can't keep all their terms, and mention one whose count changed.
    many = held.groupBy("chunk_ord").agg(F.count("*").alias("c")).filter(F.col("c") > m["most"]).select("chunk_ord").join(touched, "chunk_ord", "left_anti")
    moved = held.join(many, "chunk_ord", "left_semi").join(d_df.select("term"), "term", "left_semi").select("chunk_ord").distinct()
    wide = written(held.join(moved, "chunk_ord", "left_semi"), "mentions")
    sides = [(old, True, False), (new, False, True), (wide, True, True)]
    rows = reduce(DataFrame.unionByName, [m_.select("chunk_ord", "term", F.lit(was).alias("was"), F.lit(now).alias("now")) for m_, was, now in sides])
    moved = written(_moved(rows, df, d_df, m["most"]), "kept")
    deltas = {"df": d_df, "kept": _terms(moved), "pairs": _pairs(moved)}
    store = f"{root}/mentions"
    src = F.col("chunk_ord").cast("string").alias("src")
    left = touched.join(new, "chunk_ord", "left_anti")
    at = logstore.upsert(spark, store, new.select(src, "chunk_ord", "term"), always=True)
    at = at if left.isEmpty() else logstore.delete(spark, store, left.select(src))
    sums = {name: _added(spark, root, m, name, d) for name, d in deltas.items()}
    return versions.commit(spark, root, number + 1, m | {"mentions": at, "sums": sums})


def postings(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """chunk_ord, term: as graph.postings of all mentions."""
    _, m = versions.read(spark, root, version)
    return _kept(logstore.read(spark, f"{root}/mentions", m["mentions"]).select("chunk_ord", "term"), _sum(spark, root, m, "df"), m["most"])


def nodes(spark: SparkSession, root: str, least: int = MIN_DF, version: int | None = None) -> DataFrame:
    """term, df: as graph.nodes, from the sums alone."""
    return _sum(spark, root, versions.read(spark, root, version)[1], "kept").filter(F.col("n") >= least).select("term", F.col("n").alias("df"))


def edges(spark: SparkSession, root: str, least: int = MIN_WEIGHT, version: int | None = None) -> DataFrame:
    """a, b, w: as graph.edges, from the sums alone."""
    return _sum(spark, root, versions.read(spark, root, version)[1], "pairs").filter(F.col("n") >= least).select("a", "b", F.col("n").alias("w"))


def _signed(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Rows counted with their signs; what cancels out is left out."""
    (one, s), (two, t) = parts
    rows = one.withColumn("n", F.lit(s)).unionByName(two.withColumn("n", F.lit(t)))
    return rows.groupBy(*one.columns).agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")


def _kept(mentions: DataFrame, df: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("chunk_ord").orderBy(F.col("n").desc(), "term")
    return mentions.join(df, "term").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("chunk_ord", "term")


def _moved(rows: DataFrame, df: DataFrame, delta: DataFrame, most: int) -> DataFrame:
    """chunk_ord, gained, lost, stayed: the terms that chunks keep now and didn't (was, now: which mentions count when), those
    that they no longer keep, and those that they keep still. A chunk that keeps what it kept has no row."""
    n = df.select("term", F.col("n").alias("before"), F.col("n").alias("after")).unionByName(delta.select("term", F.lit(0).cast("long").alias("before"), F.col("n").alias("after")))
    n = n.groupBy("term").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    top = lambda when, n: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col(when), F.struct((-F.col(n)).alias("o"), "term")))), lambda x: x["term"]), 1, most)
    kept = rows.join(n, "term").groupBy("chunk_ord").agg(top("was", "before").alias("b"), top("now", "after").alias("a"))
    sets = kept.select("chunk_ord", F.array_except("a", "b").alias("gained"), F.array_except("b", "a").alias("lost"), F.array_intersect("a", "b").alias("stayed"))
    return sets.filter((F.size("gained") > 0) | (F.size("lost") > 0))


def _terms(moved: DataFrame) -> DataFrame:
    return _signed([(moved.select(F.explode("gained").alias("term")), 1), (moved.select(F.explode("lost").alias("term")), -1)])


def _pairs(moved: DataFrame) -> DataFrame:
    """What changes in the pairs: those of a gained or lost term with what stayed and with the others of its kind."""

    def of(terms, sign):
        ends = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.lit(sign).alias("n"))
        return F.flatten(F.transform(terms, lambda x: F.transform(F.concat("stayed", F.filter(terms, lambda y: y > x)), lambda y: ends(x, y))))

    rows = apart(moved).select(F.inline(F.concat(of("gained", 1), of("lost", -1))))
    return rows.groupBy("a", "b").agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")


def _sum(spark: SparkSession, root: str, m: dict, name: str) -> DataFrame:
    rows = spark.read.schema(SUMS[name]).parquet(*m["sums"][name]) if m["sums"][name] else spark.createDataFrame([], SUMS[name])
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n")).filter("n <> 0")


def _added(spark: SparkSession, root: str, m: dict, name: str, delta: DataFrame) -> list[str]:
    """The parts of a sum with one more, or all of them as one."""
    path, held = f"{root}/{name}/part-{uuid.uuid4().hex[:12]}", m["sums"][name]
    if len(held) + 1 < FANOUT:
        delta.write.parquet(path)
        return [*held, path]
    both = _sum(spark, root, m, name).unionByName(delta)
    both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n")).filter("n <> 0").write.parquet(path)
    return [path]
