"""A stored inverted index: BM25 that reads a question's tokens and nothing else.

The index of a chunk table is a folder of segments, one for each batch, named by versioned manifests. A segment holds

* docs: kb, chunk_ord, length and tokens of each chunk, numbered;
* postings, in a folder for each bucket of tokens and in the order of tokens there: a row is a block, the chunks among 8,192
  neighbours that have a token, as offsets in the block, counts and lengths, with the largest count and the least length;
* dfs and totals: how many chunks have a token, how many there are and how long they are, negative for chunks that left;
* dead: chunks of older segments that this one removes.

Blocks of all tokens are cut at the same chunks, so what a block's chunks can score at most is the sum over the question's
tokens of what its summaries allow. The best blocks are scored first; blocks that can't reach the k-th score are never decoded.
"""

from __future__ import annotations

import re
import uuid
import zlib
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.retrieval import ALPHA, B, K1, TOP_K, cosine, dot
from loam.sources import versions

#: Chunks of a block: 2 to the power of this, 15 at most. Smaller blocks bound scores better, larger ones need fewer rows. Folders of tokens. Blocks that give the first k scores.
BLOCK_BITS, BUCKETS, SEEDS = 13, 64, 16
#: Bounds are sums of doubles in another order than scores.
SLACK = 1 + 1e-9
SCHEMAS = {
    "docs": "kb string, chunk_ord long, doc long, dl int, tokens array<string>",
    "postings": "seg int, kb string, token string, block long, n int, most_tf int, least_dl int, offs array<smallint>, tfs array<int>, dls array<int>, bucket int",
    "dfs": "kb string, token string, n long, bucket int",
    "totals": "kb string, n long, dl long",
    "dead": "seg int, doc long",
}


def create(chunks: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """A new index of chunks (chunk_ord, text; kb and breadcrumb if they have them) in the empty folder root."""
    if versions.numbers(chunks.sparkSession, root):
        raise ValueError(f"{root} holds an index")
    return apply(chunks.sparkSession, root, chunks, None, buckets)


def apply(spark: SparkSession, root: str, added: DataFrame | None = None, removed: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """The version with the chunks of removed (kb, chunk_ord) gone and those of added (as for create()) there. Only what
    changes is written. A key that the index doesn't hold removes nothing; a null kb is a store, null texts are chunks
    without tokens, and keys that added repeats are chunks each."""
    number, manifest = versions.read(spark, root)
    manifest = manifest or {"buckets": buckets, "segments": [], "next": 0}
    seg, buckets = manifest["next"], manifest["buckets"]
    name, changes = f"{seg}-{uuid.uuid4().hex[:8]}", []
    path = lambda table: f"{root}/{table}/segment={name}"
    if removed is not None and manifest["segments"]:
        gone = removed.select(_kb(removed).alias("_kb"), F.col("chunk_ord").alias("_ord")).distinct()
        held = documents(spark, root).select("seg", "doc", "kb", "chunk_ord").join(gone, F.col("kb").eqNullSafe(F.col("_kb")) & (F.col("chunk_ord") == F.col("_ord")), "left_semi")
        held.select("seg", "doc").write.parquet(path("dead"))
        held = _marked(_read(spark, root, manifest, "docs"), spark.read.schema(SCHEMAS["dead"]).parquet(path("dead")))
        changes.append({"dfs": _dfs(held, buckets), "totals": _totals(held, -1)})
    if added is not None:
        text = F.lower(T.embed_text("text", "breadcrumb") if "breadcrumb" in added.columns else F.coalesce("text", F.lit("")))
        tokens = added.select(_kb(added).alias("kb"), F.col("chunk_ord").cast("long").alias("chunk_ord"), T.tokens(text).alias("tokens"))
        tokens.select("kb", "chunk_ord", F.monotonically_increasing_id().alias("doc"), F.size("tokens").alias("dl"), "tokens").write.parquet(path("docs"))
        docs = spark.read.schema(SCHEMAS["docs"]).parquet(path("docs"))
        with _short_batches(spark):
            _postings(docs, seg, buckets).write.partitionBy("bucket").parquet(path("postings"))
        # Blocks know how many of their chunks have a token: tokens aren't read a second time.
        rows = spark.read.schema(SCHEMAS["postings"]).parquet(path("postings"))
        dfs = rows.groupBy("kb", "token", "bucket").agg(F.sum("n").alias("n")).select("kb", "token", "n", "bucket")
        changes.append({"dfs": dfs, "totals": _totals(docs, 1)})
    for table in ("dfs", "totals"):
        parts = [held[table] for held in changes]
        if parts:
            out = reduce(DataFrame.unionByName, parts)
            (out.repartition("bucket").write.partitionBy("bucket") if table == "dfs" else out.write).parquet(path(table))
    has = [*(["docs", "postings"] if added is not None else []), *(["dfs", "totals"] if changes else []), *(["dead"] if removed is not None and manifest["segments"] else [])]
    manifest = manifest | {"segments": [*manifest["segments"], {"name": name, "seg": seg, "has": has}], "next": seg + 1}
    return versions.commit(spark, root, number + 1, manifest)


def upsert(spark: SparkSession, root: str, chunks: DataFrame) -> int:
    """Chunks of the same kb and chunk_ord are replaced, others added."""
    return apply(spark, root, chunks, chunks)


def compact(spark: SparkSession, root: str) -> int:
    """The version in one segment, without the chunks that left. Blocks that lost none are copied as they are."""
    number, manifest = versions.read(spark, root)
    name = f"{manifest['next']}-{uuid.uuid4().hex[:8]}"
    path = lambda table: f"{root}/{table}/segment={name}"
    dead, rows = (_read(spark, root, manifest, table) for table in ("dead", "postings"))
    hit = dead.select("seg", F.shiftright("doc", BLOCK_BITS).alias("block")).distinct()
    whole = rows.join(hit, ["seg", "block"], "left_anti")
    left = _alive(_decoded(rows.join(hit, ["seg", "block"], "left_semi")), dead)
    _blocks(left).select(*whole.columns).unionByName(whole).repartitionByRange("bucket", "token", "seg", "block").sortWithinPartitions("bucket", "token", "seg", "block").write.partitionBy("bucket").parquet(path("postings"))
    documents(spark, root).write.parquet(path("docs"))
    _read(spark, root, manifest, "dfs").groupBy("kb", "token", "bucket").agg(F.sum("n").alias("n")).filter("n <> 0").repartition("bucket").write.partitionBy("bucket").parquet(path("dfs"))
    _read(spark, root, manifest, "totals").groupBy("kb").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).write.parquet(path("totals"))
    segment = {"name": name, "seg": None, "has": ["docs", "postings", "dfs", "totals"]}
    return versions.commit(spark, root, number + 1, manifest | {"segments": [segment], "next": manifest["next"] + 1})


def documents(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """seg, kb, chunk_ord, doc, dl, tokens of the chunks that the index holds."""
    _, manifest = versions.read(spark, root, version)
    docs = _read(spark, root, manifest, "docs")
    return _alive(docs, _read(spark, root, manifest, "dead")) if _has(manifest, "dead") else docs


def scores(spark: SparkSession, root: str, question: str, by: list[str] | None = None, version: int | None = None) -> DataFrame:
    """kb, chunk_ord, bm25 of every chunk that has a token of the question, as retrieval.bm25 gives them: over the whole
    index, or over each store where by is ["kb"]. A question without tokens, or an empty index, finds nothing."""
    held = _Question(spark, root, question, by or [], version)
    return held.named(held.scored(held.rows))


def topk(spark: SparkSession, root: str, question: str, k: int = TOP_K, version: int | None = None) -> DataFrame:
    """kb, chunk_ord, bm25: the k best of scores(), ties by chunk_ord (null kb first among equal ones)."""
    held = _Question(spark, root, question, [], version)
    best = held.bounds().orderBy(F.col("bound").desc()).limit(SEEDS)
    first = held.scored(held.rows.join(F.broadcast(best), ["seg", "block"], "left_semi"))
    floor = [r.bm25 for r in first.select("bm25").orderBy(F.col("bm25").desc()).limit(k).collect()]  # k numbers
    rows = held.rows
    if len(floor) == k:
        rows = rows.join(held.bounds().filter(F.col("bound") >= floor[-1]).select("seg", "block"), ["seg", "block"], "left_semi")
        # Of the chunks that are scored, none under the floor is looked up.
        return held.named(held.scored(rows).filter(F.col("bm25") >= floor[-1])).orderBy(F.col("bm25").desc(), "chunk_ord", "kb").limit(k)
    return held.named(held.scored(rows)).orderBy(F.col("bm25").desc(), "chunk_ord", "kb").limit(k)


def hybrid_topk(chunks: DataFrame, root: str, question: str, query: DataFrame, k: int = TOP_K, alpha: float = ALPHA) -> DataFrame:
    """chunks (kb, chunk_ord, embedding: those of the index) with bm25, norm, vec, score: what retrieval.hybrid_topk finds,
    without reading a text. (kb, chunk_ord) is a key of chunks."""
    spark = chunks.sparkSession
    found = scores(spark, root, question).select(F.col("kb").alias("_kb"), F.col("chunk_ord").alias("_ord"), F.col("bm25"))
    on = _kb(chunks).eqNullSafe(F.col("_kb")) & (F.col("chunk_ord") == F.col("_ord"))
    rows = chunks.drop("bm25", "norm", "vec", "score").join(found, on, "left").drop("_kb", "_ord").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    ends = rows.agg(F.min("bm25").alias("_lo"), F.max("bm25").alias("_hi"))
    row = query.limit(1).select(F.col("qv").alias("_qv"), F.sqrt(dot(F.col("qv"), F.col("qv"))).alias("_qn"))
    both = rows.crossJoin(F.broadcast(ends.crossJoin(row)))  # one row
    norm = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col("bm25") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    vec = F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("_qv"), F.col("_qn")))
    out = both.withColumn("norm", norm).withColumn("vec", vec).drop("_qv", "_qn", "_lo", "_hi")
    return out.withColumn("score", alpha * F.col("vec") + (1 - alpha) * F.col("norm")).orderBy(F.col("score").desc(), "chunk_ord").limit(k)


class _Question:
    """The blocks of a question's tokens, and what weighs them."""

    def __init__(self, spark: SparkSession, root: str, question: str, by: list[str], version: int | None):
        _, manifest = versions.read(spark, root, version)
        found = re.findall(T.TOKEN, question.lower())
        self.spark, self.root, self.version, self.by = spark, root, version, by
        self.words, self.times = list(dict.fromkeys(found)), [found.count(w) for w in dict.fromkeys(found)]
        mine = lambda rows: rows.filter(F.col("bucket").isin([zlib.crc32(w.encode()) % manifest["buckets"] for w in self.words]) & F.col("token").isin(self.words)) if self.words else rows.limit(0)
        self.dead = _read(spark, root, manifest, "dead") if _has(manifest, "dead") else None
        df = mine(_read(spark, root, manifest, "dfs")).groupBy(*by).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("token") == w, F.col("n"))), F.lit(0)) for w in self.words]).cast("array<long>").alias("df"))
        size = _read(spark, root, manifest, "totals").groupBy(*by).agg(F.sum("n").alias("all"), F.try_divide(F.sum("dl"), F.sum("n")).alias("avg")).filter(F.col("all") > 0)
        # A row, or one a store: words of the question and two numbers.
        same = reduce(Column.__and__, [df[c].eqNullSafe(size[c]) for c in by], F.lit(True))
        weights = df.join(size, same).select(*[df[c].alias(f"_{c}") for c in by], "df", "all", "avg")
        rows = mine(_read(spark, root, manifest, "postings")).withColumn("i", F.array_position(F.array(*map(F.lit, self.words)), F.col("token")).cast("int") - 1)
        on = reduce(Column.__and__, [rows[c].eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
        self.rows = rows.join(weights if by else F.broadcast(weights), on)

    def _part(self, tf: Column, dl: Column) -> Column:
        """What one token adds to a score."""
        df = F.get("df", F.col("i"))
        idf = F.log(1 + (F.col("all") - df + 0.5) / (df + 0.5))
        return F.get(F.array(*map(F.lit, self.times)), F.col("i")) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avg")))

    def bounds(self) -> DataFrame:
        return self.rows.withColumn("part", self._part(F.col("most_tf"), F.col("least_dl"))).groupBy("seg", "block").agg((F.sum("part") * SLACK).alias("bound"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """seg, doc, bm25: tokens are added in the order of the question."""
        parts = _decoded(rows, "i", "df", "all", "avg").withColumn("part", self._part(F.col("tf"), F.col("dl")))
        parts = parts if self.dead is None else _alive(parts, self.dead)
        each = parts.groupBy("seg", "doc").agg(*[F.sum(F.when(F.col("i") == i, F.col("part"))).alias(f"p{i}") for i in range(len(self.words))] or [F.lit(0.0).alias("p")])
        return each.select("seg", "doc", reduce(Column.__add__, [F.coalesce(f"p{i}", F.lit(0.0)) for i in range(len(self.words))], F.lit(0.0)).alias("bm25"))

    def named(self, found: DataFrame) -> DataFrame:
        return documents(self.spark, self.root, self.version).select("seg", "doc", "kb", "chunk_ord").join(found, ["seg", "doc"]).select("kb", "chunk_ord", "bm25")


def _kb(chunks: DataFrame) -> Column:
    return (F.col("kb") if "kb" in chunks.columns else F.lit(None)).cast("string")


def _bucket(buckets: int) -> Column:
    return (F.crc32(F.col("token").cast("binary")) % buckets).cast("int").alias("bucket")


def _has(manifest: dict, table: str) -> bool:
    return any(table in s["has"] for s in manifest.get("segments", []))


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows. Those of createDataFrame([]) come from Python, which starts a second set of workers beside those of SQL."""
    row = F.from_json(F.lit(None).cast("string"), schema).alias("row")
    return spark.range(0).select(row).select("row.*")


def _read(spark: SparkSession, root: str, manifest: dict, table: str) -> DataFrame:
    """A table of all segments; docs get the number of theirs."""
    held = [(f"{root}/{table}/segment={s['name']}", s["seg"]) for s in manifest.get("segments", []) if table in s["has"]]
    schema = SCHEMAS[table]
    read = lambda schema, *paths: spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*paths).drop("segment")
    if table != "docs":
        return read(schema, *[p for p, _ in held]) if held else _none(spark, schema)
    with_seg = "seg int, " + schema
    # A compacted segment keeps the numbers of those that it is made of.
    parts = [read(with_seg, p) if seg is None else read(schema, p).select(F.lit(seg).alias("seg"), "*") for p, seg in held]
    return reduce(DataFrame.unionByName, parts) if parts else _none(spark, with_seg)


def _alive(rows: DataFrame, dead: DataFrame) -> DataFrame:
    return rows.join(dead, ["seg", "doc"], "left_anti")


#: Rows of 64 chunks each that are broadcast; more are shuffled.
MASKS = 200_000


def _marked(docs: DataFrame, dead: DataFrame) -> DataFrame:
    """The rows of docs that dead names. A bit tells of each chunk whether it is named, so tokens stay where they lie."""
    word = F.shiftright("doc", 6)
    bits = dead.groupBy("seg", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("doc").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    bits = F.broadcast(bits) if bits.limit(MASKS + 1).count() <= MASKS else bits
    bit = F.call_function("shiftright", F.col("bits"), F.col("doc").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return docs.withColumn("word", word).join(bits, ["seg", "word"]).filter(bit == 1).drop("word", "bits")


#: Tokens of documents that a task turns into postings at a time, and bytes of documents that it is sent at a time: of Spark's
#: 64 MB both sides hold two, in each worker.
TOKENS, SENT = 1 << 19, 4 << 20
#: Tasks that sort the postings of a bucket of tokens.
DEALT = 4


@contextmanager
def _short_batches(spark: SparkSession):
    """Arrow batches of some SENT bytes in what is run within."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{SENT}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _postings(docs: DataFrame, seg: int, buckets: int) -> DataFrame:
    """The blocks of docs. Neighbours lie together, so tasks turn them into blocks where they are, and whole blocks are
    shuffled; a block that two tasks share has a row from each."""
    bits = BLOCK_BITS

    def invert(batches):
        import pyarrow as pa

        held, room = [], TOKENS
        for batch in batches:
            upto = np.cumsum(batch["dl"].to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                before = int(upto[first - 1]) if first else 0
                last = max(first if held else first + 1, int(np.searchsorted(upto, before + room, side="right")))
                if last > first:
                    held.append(batch.slice(first, last - first))
                    room -= int(upto[last - 1]) - before
                if last < batch.num_rows:
                    yield from _inverted(pa.Table.from_batches(held), bits)
                    held, room = [], TOKENS
                first = last
        if held:
            yield from _inverted(pa.Table.from_batches(held), bits)

    rows = docs.select("kb", "doc", "dl", "tokens").mapInArrow(invert, "kb string, token string, block long, n int, most_tf int, least_dl int, offs array<smallint>, tfs array<int>, dls array<int>")
    # By hash: ranges are drawn from a first pass, which would make all postings twice. A bucket's tokens go to DEALT tasks.
    dealt = F.crc32(F.col("token").cast("binary")) % (buckets * DEALT)
    return rows.select(F.lit(seg).alias("seg"), "*", _bucket(buckets)).repartition("bucket", dealt).sortWithinPartitions("bucket", "token", "block")


def _inverted(rows, bits: int):
    """Arrow batches of blocks of an Arrow table of kb, doc, dl, tokens."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tokens = rows["tokens"].combine_chunks()
    words = pc.list_flatten(tokens).dictionary_encode()
    if not len(words):
        return
    kbs = rows["kb"].combine_chunks().dictionary_encode()
    kb = pc.fill_null(kbs.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    docs, lengths = (rows[c].to_numpy() for c in ("doc", "dl"))
    # One number of store, token and place in the order of doc: a single sort gives blocks and counts.
    order = np.argsort(docs)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    many, high = np.int64(len(words.dictionary)), np.int64(len(order))
    row = pc.list_parent_indices(tokens).to_numpy()
    key, tf = np.unique((kb[row] * many + words.indices.to_numpy(zero_copy_only=False)) * high + rank[row], return_counts=True)
    pair, at = np.divmod(key, high)
    row = order[at]
    doc, dl = docs[row], lengths[row]
    block = doc >> bits
    new = np.ones(len(row), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    store, word = np.divmod(pair[at], many)
    ends = np.append(at, len(row)).astype(np.int32)
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
    store = pa.array(np.maximum(store - 1, 0), mask=store == 0)
    out = pa.table([
        kbs.dictionary.take(store), words.dictionary.take(pa.array(word)), pa.array(block[at]), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, at), pa.int32()), pa.array(np.minimum.reduceat(dl, at), pa.int32()),
        lists(doc & ((1 << bits) - 1), pa.int16()), lists(tf, pa.int32()), lists(dl, pa.int32())], names=["kb", "token", "block", "n", "most_tf", "least_dl", "offs", "tfs", "dls"])
    yield from out.combine_chunks().to_batches(max_chunksize=8192)


def _blocks(rows: DataFrame) -> DataFrame:
    """seg, kb, doc, dl, token, tf, bucket as blocks."""
    block, off = F.shiftright("doc", BLOCK_BITS), F.col("doc").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("smallint")
    held = rows.groupBy("seg", "kb", "token", block.alias("block"), "bucket").agg(F.array_sort(F.collect_list(F.struct(off.alias("off"), "tf", "dl"))).alias("x"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))
    of = lambda name: F.transform("x", lambda e: e[name])
    return held.select("seg", "kb", "token", "block", F.size("x").alias("n"), "most_tf", "least_dl", of("off").alias("offs"), of("tf").alias("tfs"), of("dl").alias("dls"), "bucket")


def _decoded(rows: DataFrame, *more: str) -> DataFrame:
    base = F.shiftleft("block", BLOCK_BITS)
    each = rows.select("seg", "kb", "token", "bucket", base.alias("base"), *more, F.explode(F.arrays_zip("offs", "tfs", "dls")).alias("x"))
    return each.select("seg", "kb", "token", "bucket", *more, (F.col("base") + F.col("x.offs")).alias("doc"), F.col("x.tfs").alias("tf"), F.col("x.dls").alias("dl"))


def _dfs(docs: DataFrame, buckets: int) -> DataFrame:
    """How many of the chunks that leave have a token, negative."""
    each = docs.select("kb", F.explode(F.array_distinct("tokens")).alias("token"))
    return each.groupBy("kb", "token").agg((F.count("*") * -1).alias("n")).select("kb", "token", "n", _bucket(buckets))


def _totals(docs: DataFrame, sign: int) -> DataFrame:
    return docs.groupBy("kb").agg((F.count("*") * sign).alias("n"), (F.sum("dl").cast("long") * sign).alias("dl"))
