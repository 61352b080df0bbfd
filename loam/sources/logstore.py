"""A chunk store as a log of deltas: what is written grows with the batch, not with the store.

A delta holds a batch's chunks, in a folder for each bucket of sources, how many chunks each of its sources has, and the
sources whose older chunks it replaces or removes. Readers merge: a chunk counts unless a later delta names its source.
Deltas of a level are compacted into one of the next when there are `fanout` of them. Manifests are versioned, so that a
version stays readable until its folders are removed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.sources import versions

BUCKETS, FANOUT = 64, 4
BUCKET, SEQ = "_bucket", "_seq"


def create(spark: SparkSession, root: str, schema: T.StructType, buckets: int = BUCKETS, fanout: int = FANOUT) -> int:
    """An empty store of chunks with a column src in the empty folder root. No column may be named _bucket or _seq."""
    if {BUCKET, SEQ} & {c.lower() for c in schema.names}:
        raise ValueError(f"{BUCKET} and {SEQ} are the store's own columns")
    return versions.commit(spark, root, 0, {"schema": schema.jsonValue(), "buckets": buckets, "fanout": fanout, "deltas": [], "next": 0, "batches": {}})


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The chunks of the newest version, or of the one named. A filter on src reads the sources' buckets alone if it is
    passed to of_sources()."""
    _, m = versions.read(spark, root, version)
    return _merged(spark, root, m, m["deltas"])


def of_sources(spark: SparkSession, root: str, sources: list[str], version: int | None = None) -> DataFrame:
    """The chunks of some sources, from their buckets."""
    _, m = versions.read(spark, root, version)
    named = spark.createDataFrame([(s,) for s in sources], "src string")
    buckets = [r[0] for r in named.select(_bucket(m)).distinct().collect()]
    return _merged(spark, root, m, m["deltas"], buckets).filter(F.col("src").isin(sources))


def counts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """src, n of the sources that the store holds, without reading a chunk."""
    _, m = versions.read(spark, root, version)
    return _alive(spark, root, m, m["deltas"], _table(spark, root, m["deltas"], "counts", "src string, n long")).drop(SEQ)


def upsert(spark: SparkSession, root: str, incoming: DataFrame, batch: str | None = None, always: bool = False) -> int:
    """The version after an upsert by source: a source held with as many chunks stays, another is replaced, new ones follow
    (as corpus.upsert); with always, every source that comes is replaced. A named batch that the store has already seen changes nothing, so a stream may repeat its last one.
    Null sources are a source. Columns go by name; those that the store lacks are dropped, missing ones are null."""
    number, m = versions.read(spark, root)
    if batch is not None and batch in m["batches"]:
        return number
    schema = T.StructType.fromJson(m["schema"])
    have = {c.lower() for c in incoming.columns}
    rows = incoming.select(*[(F.col(c.name) if c.name.lower() in have else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema])
    name, delta = _name(m), {"seq": m["next"], "level": 0}
    # The batch is written once; what is held as it is is left out by a join of counts.
    stage = f"{root}/stage/delta={name}"
    rows.write.parquet(stage)
    rows = spark.read.schema(schema).parquet(stage)
    fresh = rows.groupBy("src").agg(F.count("*").alias("n"))
    held = counts(spark, root).select(F.col("src").alias("_src"), F.col("n").alias("_n"))
    both = fresh.join(held, F.col("src").eqNullSafe(F.col("_src")), "left").filter(F.lit(always) | F.col("_n").isNull() | (F.col("_n") != F.col("n")))
    both.select("src", "n", F.col("_n").isNotNull().alias("old")).write.parquet(f"{root}/counts/delta={name}")
    mine = spark.read.schema("src string, n long, old boolean").parquet(f"{root}/counts/delta={name}")
    keys = mine.select(F.col("src").alias("_src"))
    _write(rows.join(keys, F.col("src").eqNullSafe(F.col("_src")), "left_semi"), m, f"{root}/chunks/delta={name}")
    mine.filter("old").select("src").write.parquet(f"{root}/gone/delta={name}")
    versions.remove(spark, stage)
    batches = m["batches"] | ({batch: number + 1} if batch is not None else {})
    return _commit(spark, root, number, m | {"batches": batches}, delta | {"name": name, "has": ["chunks", "counts", "gone"]})


def delete(spark: SparkSession, root: str, sources: DataFrame) -> int:
    """The version without the sources (src) named; sources that it doesn't hold are passed over."""
    number, m = versions.read(spark, root)
    name = _name(m)
    sources.select(F.col("src").cast("string").alias("src")).distinct().write.parquet(f"{root}/gone/delta={name}")
    return _commit(spark, root, number, m, {"seq": m["next"], "level": 0, "name": name, "has": ["gone"]})


def sink(root: str, stream: str):
    """foreachBatch of a stream of chunks into the store: each batch once, however often it is run."""

    def run(rows: DataFrame, epoch: int) -> None:
        upsert(rows.sparkSession, root, rows, f"{stream}/{epoch}")

    return run


def _name(m: dict) -> str:
    return f"{m['next']}-{uuid.uuid4().hex[:8]}"


def _bucket(m: dict):
    return F.pmod(F.xxhash64("src"), F.lit(m["buckets"])).cast("int").alias(BUCKET)


def _write(rows: DataFrame, m: dict, path: str) -> None:
    rows.withColumn(BUCKET, _bucket(m)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def _commit(spark: SparkSession, root: str, number: int, m: dict, delta: dict) -> int:
    m = m | {"deltas": [*m["deltas"], delta], "next": m["next"] + 1}
    number = versions.commit(spark, root, number + 1, m)
    level = 0
    while len(run := [d for d in m["deltas"] if d["level"] == level]) >= m["fanout"]:
        number, m = _compact(spark, root, number, m, run, level + 1)
        level += 1
    return number


def _compact(spark: SparkSession, root: str, number: int, m: dict, run: list[dict], level: int) -> tuple[int, dict]:
    """The deltas of a level, which are neighbours in order, as one of the next level. The oldest delta of all needs no
    longer say what it removed."""
    name, has = _name(m), []
    last = {"seq": max(d["seq"] for d in run), "level": level, "name": name}
    if any("chunks" in d["has"] for d in run):
        _write(_merged(spark, root, m, run), m, f"{root}/chunks/delta={name}")
        held = _alive(spark, root, m, run, _table(spark, root, run, "counts", "src string, n long"))
        held.select("src", "n").write.parquet(f"{root}/counts/delta={name}")
        has += ["chunks", "counts"]
    older = [d for d in m["deltas"] if d["seq"] < min(x["seq"] for x in run)]
    if older and any("gone" in d["has"] for d in run):
        _table(spark, root, run, "gone", "src string").select("src").distinct().write.parquet(f"{root}/gone/delta={name}")
        has.append("gone")
    later = [d for d in m["deltas"] if d["seq"] > last["seq"]]
    m = m | {"deltas": [*older, last | {"has": has}, *later], "next": m["next"] + 1}
    return versions.commit(spark, root, number + 1, m), m


def _table(spark: SparkSession, root: str, deltas: list[dict], table: str, schema) -> DataFrame:
    """A table of some deltas, each row with its delta's place in order."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    parts = [spark.read.schema(kind).option("basePath", f"{root}/{table}/delta={d['name']}").parquet(f"{root}/{table}/delta={d['name']}").select("*", F.lit(d["seq"]).alias(SEQ)) for d in deltas if table in d["has"]]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], T.StructType([*kind.fields, T.StructField(SEQ, T.IntegerType())]))


def _alive(spark: SparkSession, root: str, m: dict, deltas: list[dict], rows: DataFrame) -> DataFrame:
    """Rows with src and _seq that no later one of the deltas replaces."""
    if not any("gone" in d["has"] for d in deltas):
        return rows
    gone = _table(spark, root, deltas, "gone", "src string").groupBy(F.col("src").alias("_src")).agg(F.max(SEQ).alias("_last"))
    return rows.join(gone, F.col("src").eqNullSafe(F.col("_src")) & (F.col(SEQ) < F.col("_last")), "left_anti")


def _merged(spark: SparkSession, root: str, m: dict, deltas: list[dict], buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"])
    rows = _table(spark, root, deltas, "chunks", schema.add(BUCKET, T.IntegerType()) if deltas else schema)
    if buckets is not None and BUCKET in rows.columns:
        rows = rows.filter(F.col(BUCKET).isin(buckets))
    return _alive(spark, root, m, deltas, rows).select(*T.StructType.fromJson(m["schema"]).names)
