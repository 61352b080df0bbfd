"""Tables in ranges of a column, that are searched from the front until enough is found."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources import versions

#: Files that a search reads first; each further step reads as many again as all before, and these.
FIRST = 1


def write(rows: DataFrame, root: str, order: str, files: int | None = None) -> int:
    """A version of the table at root: sorted files in ranges of `order`, a number that may be null (nulls come first), and a
    manifest of each file's range."""
    spark = rows.sparkSession
    number, _ = versions.read(spark, root)
    folder = f"{root}/rows-{uuid.uuid4().hex[:12]}"
    dealt = rows.repartitionByRange(files, F.col(order).asc_nulls_first()) if files else rows.repartitionByRange(F.col(order).asc_nulls_first())
    dealt.sortWithinPartitions(F.col(order).asc_nulls_first()).write.parquet(folder)
    held = spark.read.schema(rows.schema).parquet(folder).groupBy(F.input_file_name().alias("file")).agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n"))
    names = [(r.file, r.low, r.high, r.n) for r in held.orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first()).collect()]  # a row a file
    return versions.commit(spark, root, number + 1, {"order": order, "schema": rows.schema.jsonValue(), "files": names})


def first(spark: SparkSession, root: str, condition: Column, limit: int) -> tuple[DataFrame, int]:
    """(the first `limit` rows in order for which the condition holds, how many files were read). Files are read from the front
    in steps that double, until the limit is met by those read so far; without enough hits that is the whole table, in as many
    jobs as the logarithm of its files."""
    from pyspark.sql.types import StructType

    _, m = versions.read(spark, root)
    schema, names = StructType.fromJson(m["schema"]), [f for f, *_ in m["files"]]
    many = 0
    while True:
        many = min(len(names), 2 * many + FIRST)
        rows = spark.read.schema(schema).parquet(*names[:many]) if many else spark.createDataFrame([], schema)
        hits = rows.filter(condition)
        if many == len(names) or hits.limit(limit).count() == limit:
            return hits.orderBy(F.col(m["order"]).asc_nulls_first()).limit(limit), many
