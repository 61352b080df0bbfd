"""Versioned manifests: small JSON files that say which folders a table is made of.

A writer puts its folders beside the others and then a manifest of the next number, which is created only if it isn't there:
of two writers one fails and starts anew. Readers take the newest manifest, or an older one; folders that no manifest names
are leftovers of writers that failed.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions that root has, ascending."""
    files, path = _files(spark, root)
    folder = path(f"{root}/manifest")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """(number, manifest) of the newest version, or of the one named; (-1, {}) where there is none. A manifest whose writer
    died halfway counts as none."""
    for n in reversed(numbers(spark, root)):
        if version is None or n == version:
            try:
                return n, json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(_opened(spark, f"{root}/manifest/v{n}.json"), "UTF-8"))
            except ValueError:
                pass
    if version is not None:
        raise ValueError(f"{root} has no version {version}")
    return -1, {}


def _opened(spark: SparkSession, path: str):
    files, of = _files(spark, path)
    return files.open(of(path))


def commit(spark: SparkSession, root: str, number: int, manifest: dict) -> int:
    """Makes manifest version `number` of root; an error if that number is taken."""
    files, path = _files(spark, root)
    out = files.create(path(f"{root}/manifest/v{number}.json"), False)
    try:
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
    finally:
        out.close()
    return number


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no manifest names."""
    files, of = _files(spark, path)
    files.delete(of(path), True)
