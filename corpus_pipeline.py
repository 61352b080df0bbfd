"""Corpus pipeline: language ID, line dedup, near-dedup, packing. Part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the shared
folder and reads it again as the next stage's docs. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import langid, line_dedup, near_dedup, packing
from loam.llm.shared import short_batches, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang becomes the predicted language. Rejected documents go.

    Null, empty and letterless texts are rejected; equal rows share one fate; all columns ride along; with no row that has
    both text and lang nothing can be learned and every document is rejected; an empty table stays empty."""
    short_batches(spark)
    dictionaries = langid.fit(docs.select("text", "lang"))
    out = langid.classify(docs, dictionaries).filter(~F.col("rejected"))
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 documents go; a document that loses all its lines stays, with an empty text.

    Null text becomes empty; blank lines stay; repeated rows count as documents of their own; all columns ride along
    (n_chars counts anew); an empty table stays empty."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest doc_id; other rows of a doc_id are rows of
    their own. Rows without a text of at least one word or without a doc_id all stay; an empty table stays empty."""
    short_batches(spark)
    return near_dedup.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens: a row for each piece of each document, an empty text's end included;
    repeated rows and null doc_ids are packed like others; an empty table gives no rows."""
    short_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("packing", packed)]
#: The first stage is no SQL; tests/llm hold run() against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
