"""Table functions for SQL and lateral joins: chunk(text[, size, overlap]), extract(path, content), diff_lines(old, new).

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL chunk(text) AS c")
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loam.functions import diff
from loam.functions.text import spare
from loam.operators import chunking
from loam.sources import files


class Chunk:
    def eval(self, text: str, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP):
        for i, (piece, breadcrumb) in enumerate(chunking.chunks(text, size, overlap)):
            yield i, piece, breadcrumb


class Extract:
    def eval(self, path: str, content: bytes):
        yield files.extracted(path, content)


class DiffLines:
    def eval(self, old: str, new: str):
        ratio, found = diff.hunks((old or "").splitlines(), (new or "").splitlines())
        for i, h in enumerate(found):
            yield i, *h, ratio
        if not found:
            yield None, None, None, None, None, None, ratio


SCHEMAS = {
    "chunk": (Chunk, "chunk_ord int, text string, breadcrumb string"),
    "extract": (Extract, "ext string, text string, error string"),
    "diff_lines": (DiffLines, "hunk int, old_start int, old_lines int, new_start int, new_lines int, lines string, ratio double"),
}


def function(name: str):
    """The table function as a Python function of columns, for DataFrame.lateralJoin."""
    kind, schema = SCHEMAS[name]
    return udtf(kind, returnType=schema, useArrow=True)


def register(spark: SparkSession) -> None:
    """All of them for SQL. Null texts have no chunks, count as empty in a difference, and null contents can't be read; two
    equal texts have one row without a hunk, of ratio 1."""
    for name in SCHEMAS:
        spark.udtf.register(name, function(name))


def diffs(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows with hunk, old_start, old_lines, new_start, new_lines, lines, ratio: a row for each hunk of the shortest edit
    script by lines, with two lines of context; one of null hunk where both texts have the same lines. Columns of rows that
    have these names are replaced."""
    base = rows.drop(*[c for c in ("hunk", "old_start", "old_lines", "new_start", "new_lines", "lines", "ratio") if c not in (old, new)])
    a, b = spare(base, "a"), spare(base, "b")
    named = base.withColumns({a: F.col(old), b: F.col(new)})
    return named.lateralJoin(function("diff_lines")(F.col(a).outer(), F.col(b).outer())).drop(a, b)
