"""Entity co-occurrence graphs and wiki link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.sources.scratch import written

MAX_ENTITIES, MIN_DF, MIN_WEIGHT = 40, 2, 2


def postings(mentions: DataFrame, most: int = MAX_ENTITIES) -> DataFrame:
    """chunk_ord, term: distinct mentions; a chunk keeps its `most` most frequent terms (ties by term)."""
    found = mentions.select("chunk_ord", "term").distinct()
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    w = Window.partitionBy("chunk_ord").orderBy(F.col("df").desc(), "term")
    return found.join(df, "term").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("chunk_ord", "term")


def nodes(held: DataFrame, least: int = MIN_DF, seeds: tuple[str, ...] = ()) -> DataFrame:
    """term, df of the terms of at least `least` chunks; seed terms of 2 to 12 characters are nodes however rare, of df 1 at
    least."""
    df = held.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)
    wanted = sorted({t for s in seeds if 2 <= len(t := s.strip()) <= 12})
    if not wanted:
        return df
    extra = held.sparkSession.createDataFrame([(t, 1) for t in wanted], "term string, df long")
    return df.unionByName(extra).groupBy("term").agg(F.max("df").alias("df"))


def top_nodes(nodes_: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent nodes, ties by term."""
    return nodes_.orderBy(F.col("df").desc(), "term").limit(n)


def kept_edges(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """The edges between nodes."""
    end = lambda c: nodes_.select(F.col("term").alias(c))
    return edges_.join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi").select("a", "b", "w")


#: Chunks whose pairs (780 at most for 40 terms) a task makes and counts.
PAIRED = 8192


def apart(chunks: DataFrame) -> DataFrame:
    """A written table with a row for each chunk, dealt so that no task has many more than PAIRED: what it makes of its chunks
    is a multiple of what it reads, which the size of a partition doesn't show."""
    return chunks.repartition(max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // PAIRED)), "chunk_ord")


#: Pairs that a task counts, of all chunks.
COUNTED = 1 << 21


def numbered(terms: DataFrame) -> DataFrame:
    """term, id: terms (term, df) by numbers from 0, the rare ones first, ties by term."""
    at = written(terms.orderBy("df", "term").select("term", F.monotonically_increasing_id().alias("at")), "numbers")
    part = F.shiftright("at", 33)  # of the sort; a row each below
    sizes = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return at.join(F.broadcast(before), part == F.col("part")).select("term", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"))


def edges(held: DataFrame, least: int = MIN_WEIGHT) -> DataFrame:
    """a, b, w of undirected pairs a < b: in how many chunks both stand, all pairs of at least `least`, of any number of terms
    a chunk.

    Terms of fewer chunks have no such pair. Chunks of equal terms are counted once, with their number. Each term of a
    chunk is sent with those that are more frequent, so pairs meet at the rarer term, and only a chunk's list travels."""
    df = held.groupBy("term").agg(F.countDistinct("chunk_ord").alias("df")).filter(F.col("df") >= least)
    ids = written(numbered(df), "terms")
    chunks = held.join(ids, "term").groupBy("chunk_ord").agg(F.array_sort(F.collect_set("id")).alias("t")).filter(F.size("t") > 1)
    sets = written(chunks.groupBy("t").agg(F.count("*").alias("n")), "sets")
    size = F.size("t").cast("long")
    parts = -(-(sets.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0) // COUNTED)
    lists = sets.select("n", "t", F.posexplode("t").alias("i", "x")).filter(F.col("i") + 1 < F.size("t")).select("x", F.slice("t", F.col("i") + 2, F.size("t")).alias("others"), "n")
    lists = lists.repartition(max(held.sparkSession.sparkContext.defaultParallelism, int(parts)), "x")
    pairs = lists.select("x", F.explode("others").alias("y"), "n").groupBy("x", "y").agg(F.sum("n").alias("w")).filter(F.col("w") >= least)
    name = lambda c, to: ids.select(F.col("id").alias(c), F.col("term").alias(to))
    return pairs.join(name("x", "s"), "x").join(name("y", "t"), "y").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "w")


def neighbours(edges_: DataFrame, term: str, k: int = 10) -> DataFrame:
    near = edges_.filter((F.col("a") == term) | (F.col("b") == term))
    return near.select(F.when(F.col("a") == term, F.col("b")).otherwise(F.col("a")).alias("term"), "w").orderBy(F.col("w").desc(), "term").limit(k)


def graph_stats(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    return nodes_.agg(F.count("*").alias("nodes"), F.coalesce(F.max("df"), F.lit(0)).alias("max_df")).crossJoin(edges_.agg(F.count("*").alias("edges"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("weight")))


def augment(hits: DataFrame, held: DataFrame, edges_: DataFrame, extra: int = 4) -> DataFrame:
    """chunk_ord, score of chunks that are no hits but hold a neighbour of a hit's entity: w * 0.05, at most 1."""
    own = held.join(hits.select("chunk_ord"), "chunk_ord", "left_semi").select("term").distinct()
    both = edges_.select("a", "b", "w").unionByName(edges_.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    w = Window.partitionBy("a").orderBy(F.col("w").desc(), "b")
    near = both.join(own.withColumnRenamed("term", "a"), "a", "left_semi").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= extra)
    found = near.groupBy(F.col("b").alias("term")).agg(F.max("w").alias("w")).join(held, "term").groupBy("chunk_ord").agg(F.round(F.least(F.lit(1.0), F.max("w") * F.lit(0.05)), 4).alias("score"))
    return found.join(hits.select("chunk_ord"), "chunk_ord", "left_anti")


def augment_chain(hits: DataFrame, held: DataFrame, nodes_: DataFrame, edges_: DataFrame, extra: int = 3, hops: int = 1, wide: int = 5) -> DataFrame:
    """chunk_ord, via, term, weight, score: chunks that are no hits but hold a neighbour of an entity of the hits, each with
    the first way to it.

    The hits' entities are taken from the most frequent on, until `extra` chunks are found; each leads to its `extra`
    heaviest neighbours and, with two hops, where it has fewer, on to theirs (of `wide` neighbours each `wide`, by the sum
    of both weights). Ties go by term. score: weight * 0.05, at most 1."""
    own = held.join(hits.select("chunk_ord"), "chunk_ord", "left_semi").select("term").distinct().join(nodes_, "term")
    ranked = own.withColumn("e", F.row_number().over(Window.orderBy(F.col("df").desc(), "term"))).select("e", F.col("term").alias("via"))  # the hits' terms
    both = edges_.select("a", "b", "w").unionByName(edges_.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    near = both.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.col("w").desc(), "b")))
    ways = ranked.join(near, F.col("via") == F.col("a")).select("e", "via", F.lit(1).alias("hop"), F.col("k").alias("first"), F.lit(0).alias("then"), F.col("b").alias("term"), F.col("w").alias("weight"))
    if hops > 1:
        on = near.filter(F.col("k") <= wide).select(F.col("a").alias("m"), F.col("b").alias("far"), F.col("w").alias("w2"), F.col("k").alias("k2"))
        further = ways.filter(F.col("first") <= wide).join(on, F.col("term") == F.col("m")).filter("far <> via")
        ways = ways.unionByName(further.select("e", "via", F.lit(2).alias("hop"), "first", F.col("k2").alias("then"), F.col("far").alias("term"), (F.col("weight") + F.col("w2")).alias("weight")))
    ways = ways.withColumn("n", F.row_number().over(Window.partitionBy("e").orderBy("hop", "first", "then"))).filter(F.col("n") <= extra)
    # A term, and a chunk, is found once: by the first entity, and there by the first neighbour, that leads to it.
    terms = ways.groupBy("term").agg(F.min(F.struct("e", "n", "via", "weight")).alias("w"))
    found = terms.join(held, "term").join(hits.select("chunk_ord"), "chunk_ord", "left_anti").groupBy("chunk_ord").agg(F.min(F.struct("w", "term")).alias("f"))
    found = found.select("chunk_ord", F.col("f.w.e").alias("e"), F.col("f.w.via").alias("via"), "f.term", F.col("f.w.weight").alias("weight"))
    sums = found.groupBy("e").agg(F.count("*").alias("c"))
    before = sums.select("e", F.coalesce(F.sum("c").over(Window.orderBy("e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row an entity of the hits
    out = found.join(before, "e").filter(F.col("before") < extra)
    return out.select("chunk_ord", "via", "term", "weight", F.round(F.least(F.lit(1.0), F.col("weight") * F.lit(0.05)), 4).alias("score"))


#: Rows of a block of a self-join: no task pairs more than two blocks of one key.
BLOCK = 512


def dealt(rows: DataFrame, key: str, by: str, block: int = BLOCK) -> DataFrame:
    """rows with b and parts: each key's rows in blocks of some `block` rows, by hash. Keys are counted before rows meet."""
    many = rows.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    return rows.join(many, F.col(key) == F.col("_key")).drop("_key").withColumn("b", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))


def two_hops(edges_: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, w of terms two edges apart, by the sum of both weights, the heaviest way. A hub's edges are dealt to blocks, and
    each pair of blocks is joined for itself."""
    both = edges_.select("a", "b", "w").unionByName(edges_.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    held = dealt(both.select(F.col("a").alias("m"), F.col("b").alias("end"), "w"), "m", "end", block)
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = held.select("m", F.col("b").alias("p"), others.alias("q"), F.col("end").alias("a"), "w")
    right = held.select("m", others.alias("p"), F.col("b").alias("q"), F.col("end").alias("b"), F.col("w").alias("w2"))
    return left.join(right, ["m", "p", "q"]).filter("a <> b").groupBy("a", "b").agg(F.max(F.col("w") + F.col("w2")).alias("w"))


def wiki_link_edges(pages: DataFrame) -> DataFrame:
    """src, dst: links to pages that exist, none to itself."""
    links = pages.select(F.col("topic").alias("src"), F.explode("links").alias("dst")).distinct().filter("src <> dst")
    return links.join(pages.select(F.col("topic").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def wiki_cocite_edges(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, source: pages a < b that cite the same source. The pages of a source are dealt to blocks, and each pair of blocks
    p <= q is joined for itself."""
    cites = dealt(pages.select("topic", F.explode("sources").alias("source")).distinct(), "source", "topic", block)
    left = cites.select("source", F.col("b").alias("p"), F.explode(F.sequence(F.col("b"), F.col("parts") - 1)).alias("q"), F.col("topic").alias("x"))
    right = cites.select("source", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("p"), F.col("b").alias("q"), F.col("topic").alias("y"))
    pairs = left.join(right, ["source", "p", "q"]).filter("p <> q OR x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "source")


def wiki_edges(pages: DataFrame) -> DataFrame:
    """a, b, kind, via: one undirected edge a pair; links come before co-citations, which are added to via."""
    links = wiki_link_edges(pages).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(0).alias("o"), F.lit("link").alias("via")).distinct()
    cites = wiki_cocite_edges(pages).select("a", "b", F.lit(1).alias("o"), F.concat(F.lit("co-cite:"), F.col("source")).alias("via"))
    out = links.unionByName(cites).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("o", "via"))).alias("v"))
    return out.select("a", "b", F.col("v")[0].via.alias("kind"), F.transform("v", lambda x: x.via).alias("via"))


def wiki_degrees(pages: DataFrame, edges_: DataFrame) -> DataFrame:
    """topic, in (edges that touch it as the second page), out (links from it)."""
    into = edges_.groupBy(F.col("b").alias("topic")).agg(F.count("*").alias("in_deg"))
    out = wiki_link_edges(pages).groupBy(F.col("src").alias("topic")).agg(F.count("*").alias("out_deg"))
    base = pages.select("topic").distinct().join(into, "topic", "left").join(out, "topic", "left")
    return base.select("topic", F.coalesce("in_deg", F.lit(0)).alias("in_deg"), F.coalesce("out_deg", F.lit(0)).alias("out_deg"))


def mermaid(edges_: DataFrame, most: int = 60) -> DataFrame:
    """One row: the heaviest edges as a mermaid graph."""
    top = edges_.orderBy(F.col("w").desc(), "a", "b").limit(most)
    lines = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "a", "b"))), lambda x: F.concat(F.lit("  "), x.a, F.lit(" --- "), x.b)).alias("l"))
    return lines.select(F.concat(F.lit("graph LR\n"), F.array_join("l", "\n")).alias("mermaid"))


def wiki_mermaid(edges_: DataFrame, most: int = 60) -> DataFrame:
    """One row: wiki_edges() as a mermaid graph, those first that hold for the most reasons."""
    return mermaid(edges_.withColumn("w", F.size("via")), most)


def fallback_topics(docs: DataFrame, want: int = 8, most_chars: int = 24) -> DataFrame:
    """doc_id, topic_ord, topic: headings, then the beginnings of paragraphs, then numbered fillers; unique."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter("line <> ''")
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*#*$", 1)
    lead = F.split("line", "[。！？!?；;,.，]")[0]
    rows = lines.select("doc_id", "pos", F.when(heading != "", 0).otherwise(1).alias("o"), F.substring(F.when(heading != "", heading).otherwise(lead), 1, most_chars).alias("topic")).filter("topic <> ''")
    first = rows.groupBy("doc_id", "topic").agg(F.min(F.struct("o", "pos")).alias("p"))
    filler = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(want))).alias("k")).select("doc_id", F.concat(F.lit("主题"), F.col("k").cast("string")).alias("topic"), F.struct(F.lit(2).alias("o"), F.col("k").alias("pos")).alias("p"))
    w = Window.partitionBy("doc_id").orderBy("p")
    return first.unionByName(filler).withColumn("topic_ord", F.row_number().over(w)).filter(F.col("topic_ord") <= want).select("doc_id", "topic_ord", "topic")
