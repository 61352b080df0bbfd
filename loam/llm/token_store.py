"""Token-ID store: binary shards of concatenated ids with Elias-Fano document boundaries.

A store is a set of shards and a manifest. A shard is one file:
  header   8 bytes `LOAMTOK1`, then little-endian uint64: documents, ids, bytes an id (2 or 4), rows of null doc_id
  doc ids  Elias-Fano over doc_id minus the shard's least (one signed 64-bit base before it), nulls left out
  bounds   Elias-Fano over where each document starts and the last ends: documents + 1 values
  ids      the ids of all documents one after the other, little-endian
Shards hold ascending doc_id ranges; the manifest (Parquet, a row a shard) has each shard's file, first doc_id and counts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.bpe import BYTE_BPE, tokenizer, word_encoder
from loam.llm.elias_fano import EliasFano, encode
from loam.llm.shared import mapped, put_bytes, scratch, table, texts, written

MAGIC = b"LOAMTOK1"
#: Ids a shard holds before the next one begins; one document is never divided.
SHARD_IDS = 1 << 22
MANIFEST = "part int, shard int, file string, first long, docs long, ids long"


def shard_bytes(doc_ids: list, lengths: list[int], ids: list[bytes], width: int) -> list:
    """The parts of a shard's file. ids: of each document as little-endian uint32."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
    parts = [MAGIC, struct.pack("<4Q", len(doc_ids), int(bounds[-1]), width, len(doc_ids) - len(known)), struct.pack("<q", base), encode((known - base).astype(np.uint64)), encode(bounds)]
    for x in ids:
        parts.append(x if width == 4 else np.frombuffer(x, "<u4").astype("<u2").tobytes())
    return parts


class Shard:
    """One shard by memory map. Null doc_ids come first; repeated ones stand beside each other; an empty document has its end
    id alone, and a shard without documents has none."""

    def __init__(self, uri: str):
        raw = mapped(uri)
        if raw[:8] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.docs, self.ids, width, self.nulls = struct.unpack_from("<4Q", raw, 8)
        self.base = struct.unpack_from("<q", raw, 40)[0]
        self.names = EliasFano(raw, 48)
        self.bounds = EliasFano(raw, 48 + self.names.size)
        self.flat = np.frombuffer(raw, "<u2" if width == 2 else "<u4", self.ids, 48 + self.names.size + self.bounds.size)

    def doc_ids(self, first: int = 0, end: int | None = None) -> list:
        """The doc_ids of the documents from first to end, by select."""
        end = self.docs if end is None else min(end, self.docs)
        named = np.arange(max(first, self.nulls), end) - self.nulls
        return [None] * max(0, min(end, self.nulls) - first) + (self.names.get(named).astype(np.int64) + self.base).tolist()

    def starts(self, first: int, end: int):
        """Where the documents from first to end start, and the last one ends, by select."""
        return self.bounds.get(np.arange(first, min(end, self.docs) + 1)).astype(np.int64)

    def doc(self, i: int):
        """The ids of the i-th document of the shard, by select."""
        a, b = self.bounds.get([i, i + 1]).astype(np.int64)
        return self.flat[a:b]


def write_store(docs: DataFrame, path: str | None = None, tokenizer_path: str = BYTE_BPE, end: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes all texts, ascending doc_id, into shards below path; returns the manifest (also written, path/manifest).

    Nulls in doc_id come first; rows of equal doc_id stand in the order of their texts' hashes; null text is encoded as
    empty (the end id alone); an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    tie = F.xxhash64("text")
    dealt = texts(docs).select("doc_id", "text", tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt = dealt.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = 2 if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
    stop = struct.pack("<I", end)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
        encoder = word_encoder(tokenizer_path)
        names, sizes, ids, total, made = [], [], [], 0, 0

        def close():
            uri = put_bytes(f"{path}/shards/{part:06d}-{made:06d}", shard_bytes(names, sizes, ids, width))
            return pa.RecordBatch.from_pylist([{"part": part, "shard": made, "file": uri, "first": names[0], "docs": len(names), "ids": total}], schema)

        for batch in batches:
            for part, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = encoder.encode(text.as_py()) + stop
                names.append(name)
                sizes.append(len(own) // 4)
                ids.append(own)
                total += sizes[-1]
                if total >= shard_ids:
                    yield close()
                    names, sizes, ids, total, made = [], [], [], 0, made + 1
        if names:
            yield close()

    manifest = dealt.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_store(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. Null doc_ids come first, equal ones in the
    order of their texts' hashes, an empty manifest gives no rows; documents without ids don't occur, all have an end."""
    # A row a shard: its first document starts after the ids of all shards before it.
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(manifest.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"), "part", "shard"), "offsets")
    dealt = placed.select("file", "base").repartition(F.xxhash64("file"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Shard(uri)
                for i in range(0, s.docs, 8192):
                    cut = s.starts(i, i + 8192)
                    crcs = [zlib.crc32(s.flat[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(i, i + 8192), pa.int64()), pa.array(cut[:-1] + base), pa.array(np.diff(cut)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(write_store(table(spark, sf_dir, "documents")))
