"""Tables in the folder that the driver and all executors share: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset, and only in a local session, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loam/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder."""
    spark, schema, path = df.sparkSession, df.schema, folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
