"""Streams over the event log. The log is the only unbounded data here; these are extensions with batch equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream of events; ts as a timestamp with time zone, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stats(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by kind and window, final once the watermark has passed. Works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("secs"), F.count_if(F.col("event_type") == "error").alias("err")).select(F.col("w.start").alias("start_at"), "kind", "n", "secs", "err")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")


def upsert_sink(path: str, existing, upsert):
    """foreachBatch: each batch of chunks is upserted by source hash into the store at path. A batch is written beside the
    last one, as v and its epoch, so a failed batch leaves the store as it was: a reader takes latest(). A batch that is
    run again overwrites what it wrote. Each batch writes the whole store: for stores that are small beside their batches."""

    def run(batch: DataFrame, epoch: int) -> None:
        held = existing(batch.sparkSession)
        upsert(held, batch).write.mode("overwrite").parquet(f"{path}/v{epoch:08d}")

    return run


def latest(spark, path: str) -> DataFrame | None:
    """The newest store below path that was written to its end; None before the first batch."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
    done = sorted(p.toString() for p in found if files.exists(fs.Path(p, "_SUCCESS")))
    return spark.read.parquet(done[-1]) if done else None


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what there is, and returns the result."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
