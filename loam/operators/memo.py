"""Embeddings by a table of what was embedded before: each different text goes to the provider once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.sources import versions

#: Texts of a call of the provider.
BATCH = 64


def held(spark: SparkSession, root: str, model: str) -> DataFrame:
    """key (md5 of a text), embedding: what the table at root holds for a model."""
    _, manifest = versions.read(spark, root)
    paths = [p["path"] for p in manifest.get("parts", []) if p["model"] == model]
    schema = "key string, embedding array<double>"
    rows = spark.read.schema(schema).parquet(*paths).filter("embedding IS NOT NULL") if paths else spark.createDataFrame([], schema)
    return rows.groupBy("key").agg(F.first("embedding").alias("embedding")) if len(paths) > 1 else rows


def reindex(chunks: DataFrame, root: str, model: str, provider: Callable[[list[str]], list], force: bool = False, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(chunks with embedding, one row of counts).

    Chunks without an embedding get the one of their breadcrumb and text; with force all chunks do. The different texts that
    the table lacks for the model go to the provider, `batch` at a time and once each; its answers, a vector or None for each
    text, are added to the table. A call that raises has failed for its texts: these keep what embedding they had, and are
    asked for again next time. Blank texts are never sent. Counts: total, wanted (chunks), texts (different ones), known
    (of these in the table before), embedded, failed."""
    spark = chunks.sparkSession
    had = F.col("embedding").cast("array<double>") if "embedding" in chunks.columns else F.lit(None).cast("array<double>")
    crumb = F.col("breadcrumb") if "breadcrumb" in chunks.columns else F.lit("")
    text, key, old, new = (T.spare(chunks, x) for x in ("memo_text", "memo_key", "memo_old", "memo_new"))
    body = F.coalesce(T.embed_text("text", crumb), F.lit(""))
    wanted = (T.strip(body) != "") & (F.lit(force) | had.isNull())
    rows = chunks.withColumn(old, had).withColumn(text, F.when(wanted, body)).withColumn(key, F.md5(F.col(text).cast("binary")))
    asked = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.first(text).alias("text"))
    known = held(spark, root, model)
    misses = asked.join(known, "key", "left_anti")

    def call(batches):
        import pandas as pd

        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    vectors = list(provider(part["text"].tolist()))
                except Exception:  # noqa: BLE001  the batch has failed, the others go on
                    vectors = [None] * len(part)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "embedding": [None if v is None else [float(x) for x in v] for v in vectors]})

    # Failed texts stand there without an embedding, which counts as not known.
    number, manifest = versions.read(spark, root)
    path = f"{root}/part-{uuid.uuid4().hex[:12]}"
    misses.mapInPandas(call, "key string, embedding array<double>").write.parquet(path)
    versions.commit(spark, root, number + 1, {"parts": [*manifest.get("parts", []), {"model": model, "path": path}]})
    answers = spark.read.schema("key string, embedding array<double>").parquet(path)
    both = known.unionByName(answers.filter("embedding IS NOT NULL")).select(F.col("key").alias(key), F.col("embedding").alias(new))
    out = rows.join(both, key, "left").withColumn("embedding", F.coalesce(new, old))
    columns = [*chunks.columns, *([] if "embedding" in chunks.columns else ["embedding"])]
    n = rows.agg(F.count("*").alias("total"), F.count(key).alias("wanted"), F.countDistinct(key).alias("texts"))
    done = answers.agg(F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("failed"), F.count("*").alias("sent"))
    counts = n.crossJoin(F.broadcast(done)).select("total", "wanted", "texts", (F.col("texts") - F.col("sent")).alias("known"), "embedded", "failed")  # one row
    return out.select(*columns), counts


def hashed_tokens(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A provider without a model: counts of tokens by hash, of length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        import math
        import re
        import zlib

        out = []
        for text in texts:
            v = [0.0] * dims
            for token in re.findall(T.TOKEN, text.lower()):
                v[zlib.crc32(token.encode()) % dims] += 1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed
