"""Importance resampling towards a target: hashed n-gram features, log-ratio weights, Gumbel noise.

Words are integers: each slice of texts numbers its distinct words, n-grams are tuples of those numbers, and each distinct
tuple's bytes are put together and hashed once; its bucket goes back to all its places by the tuple's rank. Neither words nor
n-grams leave their slice: what is kept of a document are the buckets of its features and how often it has them, and what
meets others is one count for each bucket.
"""

from __future__ import annotations

import re
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.shared import slices, table, texts, written
from loam.llm.spelling import CRC_SQL
from loam.operators import scan

ORDER, BUCKETS, SCALE = 3, 10_000, 1000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text that are numbered at a time.
SLICE_BYTES = 1 << 21
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Dictionary(dict):
    """word -> id, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def gram_buckets(raw: list[bytes], order: int, buckets: int):
    """(words of each text, owner of each feature, its bucket)."""
    lists = [_WORD.findall(t.lower()) for t in raw]  # bytes.lower() knows A-Z only
    n = np.array([len(x) for x in lists], np.int64)
    ids = Dictionary()
    word = np.fromiter(map(ids.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
    owner = np.repeat(np.arange(len(raw)), n)
    spaced, base = [b" " + w for w in ids], np.int64(len(ids) + 1)
    # Distinct tuples by rank; each one's hash goes on where that of the tuple before its last word ended.
    rank, crcs = word, np.fromiter(map(crc32, ids), np.int64, len(ids))
    owners, found = [owner], [crcs[rank] % buckets]
    for k in range(2, order + 1):
        many = max(0, len(word) - k + 1)
        tuples, rank = np.unique(rank[:many] * base + word[k - 1 :][:many], return_inverse=True)
        before, last = np.divmod(tuples, base)
        crcs = np.fromiter(map(crc32, map(spaced.__getitem__, last.tolist()), crcs[before].tolist()), np.int64, len(tuples))
        whole = owner[:many] == owner[k - 1 :][:many]
        owners.append(owner[:many][whole])
        found.append(crcs[rank][whole] % buckets)
    return n, np.concatenate(owners), np.concatenate(found)


def features(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets, counts (little-endian 16- and 32-bit numbers) for each row of docs."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets: 1 to 65536")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in slices(batch, pc.binary_length(batch["text"]), SLICE_BYTES):
                words, owner, bucket = gram_buckets([t.as_buffer().to_pybytes() for t in part["text"]], order, buckets)
                key, count = np.unique(owner * buckets + bucket, return_counts=True)
                doc, bucket = np.divmod(key, buckets)
                ends = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
                of = lambda x, width: pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends * np.int32(width)), pa.py_buffer(x.tobytes())])
                many = np.bincount(owner, minlength=len(words))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(words), pa.array(many), of(bucket.astype("<u2"), 2), of(count.astype("<u4"), 4)], ["doc_id", "n_words", "n_features", "buckets", "counts"])

    base = texts(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary, counts binary")


def bucket_counts(held: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: a row for each bucket that features() found, whatever the number of documents."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b, c in zip(batch["buckets"], batch["counts"]):
                total[np.frombuffer(b.as_buffer(), "<u2")] += np.frombuffer(c.as_buffer(), "<u4")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return held.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """bucket, gain: scaled log-ratio of smoothed frequencies, for the buckets of the source (bucket_counts())."""
    s_all, t_all = (x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name)) for x, name in ((source, "s_all"), (target, "t_all")))
    both = source.select("bucket", F.col("n").cast("double").alias("s")).join(target.select("bucket", F.col("n").cast("double").alias("t")), "bucket", "left")
    one = F.broadcast(s_all.join(t_all))  # a row
    ratio = (F.coalesce("t", F.lit(0.0)) + 1) * (F.col("s_all") + buckets) / ((F.col("s") + 1) * (F.col("t_all") + buckets))
    return both.join(one).select("bucket", F.floor(scale * F.log(ratio)).alias("gain"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of docs (doc_id, text); target: any table with a text.

    Of the N rows with at least min_words words the floor(percent * N / 100) of highest score are drawn and ranked from 1;
    ties go to the smaller doc_id (null first), and repeated rows count each. rank is null for all others. Null texts have
    no features and weigh 0. An empty target leaves the weights to the smoothing; an empty table gives no rows. Other columns
    are ignored."""
    held = written(features(docs, order, buckets), "features")
    aim = features(target.select(F.lit(0).alias("doc_id"), "text"), order, buckets)
    table_of = gains(bucket_counts(held, buckets), bucket_counts(aim, buckets), buckets, scale)
    by_bucket = np.zeros(buckets, np.int64)
    for bucket, gain in table_of.collect():  # a row for each bucket at most
        by_bucket[bucket] = gain

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            w = [int((by_bucket[np.frombuffer(b.as_buffer(), "<u2")] * np.frombuffer(c.as_buffer(), "<u4")).sum()) for b, c in zip(batch["buckets"], batch["counts"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(w, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind = held.schema["doc_id"].dataType.simpleString()
    weighed = held.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("out", F.col("n_words") < min_words)
    placed = scan.numbered(scored, [F.col("out"), F.col("score").desc(), F.col("doc_id")], "place")
    drawn = placed.filter(~F.col("out")).count() * percent // 100
    rank = F.when(~F.col("out") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _features_sql(of: str, key: str) -> str:
    """Features (x) of each row of a table by key, with how many of each."""
    text = f"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT {key} AS id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) || list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS x
FROM (SELECT {key}, regexp_extract_all({text}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM {of})"""


SQL = rf"""
WITH fd AS ({_features_sql("documents", "doc_id")}), fb AS ({_features_sql("benchmark", "item_id")}),
x AS (SELECT DISTINCT x FROM (SELECT x FROM fd UNION ALL SELECT x FROM fb)),
{CRC_SQL.format(of="x")},
b AS (SELECT x, crc % 10000 AS b FROM x_crc),
d AS (SELECT id, b, count(*) AS n FROM fd JOIN b USING (x) GROUP BY id, b),
s AS (SELECT b, sum(n)::DOUBLE AS s FROM d GROUP BY b), t AS (SELECT b, count(*)::DOUBLE AS t FROM fb JOIN b USING (x) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
w AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM d JOIN g USING (b) GROUP BY id),
a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('42:' || doc_id), 8))::BIGINT AS h,
      len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) >= 20 AS fit FROM documents LEFT JOIN w ON doc_id = id),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM a),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE fit)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 5 // 100 THEN rank END AS rank FROM z LEFT JOIN r ON z.doc_id = r.doc_id
"""
