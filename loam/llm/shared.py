"""Helpers of the training-data operators: the shared folder, written tables, binary side files, null-safe inputs."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local master that has none set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir: the executors of local-cluster are processes of their own")
        root = "file://" + tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root."""
    return f"{shared_root(spark)}/loam/{name}-{uuid.uuid4().hex}"


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def few_files(df: DataFrame) -> DataFrame:
    """An eighth of the shuffle partitions: for tables of some numbers a document or n-gram, so much smaller than the texts
    that they are made from that a partition of them would be a fraction of one of the texts'."""
    return df.coalesce(max(6, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of executors. few: in few files."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    (few_files(df) if few else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Tables of a few numbers a row are broadcast up to this many rows, and shuffled beyond.
BROADCAST_ROWS = 200_000


def bounded(rows: DataFrame) -> DataFrame:
    """Broadcast after its rows were counted and found few, else as it is."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the columns named, whatever else the table holds."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z lower-cased and nothing else. lower() agrees where all characters are ASCII and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def crc_mod(modulus: int):
    """crc32 of doc_id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


#: Rows of whole texts that are sent to Python at a time: Spark's 10,000 are all of a partition, held by both sides at once.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most in this session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def slices(batch, sizes, most: int):
    """Runs of rows of an Arrow batch that come to some `most` by their sizes: what is built beside them stays small."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + most)))
        yield batch.slice(first, last - first)
        first = last


def file_system(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, parts) -> str:
    """Writes the byte parts to uri plus a suffix of this attempt, and returns that name: a retried task never
    touches a file that an earlier attempt wrote, and only the name that the task returns is ever read."""
    uri = f"{uri}.{uuid.uuid4().hex[:12]}"
    files, path = file_system(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(path) as out:
        for part in parts:
            out.write(part)
    return uri


def mapped(uri: str):
    """A read-only memory map of the file. A remote file is first copied to an unlinked temporary one."""
    from pyarrow import fs

    files, path = file_system(uri)
    if isinstance(files, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as f, files.open_input_stream(path) as src:
        while block := src.read(1 << 22):
            f.write(block)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
