"""Differences, table functions and the embedding table."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import diff, tables
from loam.operators import chunking, memo
from loam.sources import files

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=14), st.lists(st.sampled_from("abcdx"), max_size=14))
def test_scripts_are_shortest(a, b):
    found = diff.matches(a, b)
    assert len(found) == lcs(a, b) and all(a[i] == b[j] for i, j in found)
    assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))


def patched(old, found):
    """old with the hunks applied."""
    out, at = [], 0
    for start, n, _, _, lines in found:
        first = start - 1 if n else start
        out += old[at:first]
        part = lines.split("\n")
        assert [x[1:] for x in part if x[0] != "+"] == old[first : first + n]
        out += [x[1:] for x in part if x[0] != "-"]
        at = first + n
    return out + old[at:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "", "d e"]), max_size=25), st.lists(st.sampled_from(["a", "b", "c", "", "x"]), max_size=25))
def test_hunks_make_the_new_text(a, b):
    ratio, found = diff.hunks(a, b)
    assert patched(a, found) == b and ratio == (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)
    for _, n, _, m, lines in found:
        marks = "".join(x[0] for x in lines.split("\n"))
        assert marks.lstrip(" ")[:1] in "-+" and len(marks) - len(marks.lstrip(" ")) <= 2 and "     " not in marks.strip(" ")


def test_known_difference():
    ratio, found = diff.hunks(list("abcdefghij"), list("abXdefghijk"))
    assert found == [(1, 5, 1, 5, " a\n b\n-c\n+X\n d\n e"), (9, 2, 9, 3, " i\n j\n+k")] and ratio == pytest.approx(18 / 21)


def test_documents_against_the_next(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    held = {r.doc_id: (r.text, r.next) for r in rows.collect()}
    got = {}
    for r in tables.diffs(rows.withColumn("lines", F.lit("clash")), "text", "next").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(held)
    for i, (a, b) in held.items():
        a, b = (a or "").splitlines(), (b or "").splitlines()
        assert got[i][0].ratio == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1)
        assert patched(a, [(r.old_start, r.old_lines, r.new_start, r.new_lines, r.lines) for r in sorted(got[i], key=lambda r: r.hunk or 0) if r.hunk is not None]) == b


def test_sql_functions(spark):
    tables.register(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.createOrReplaceTempView("documents_sql")
    key = lambda df: sorted((r.doc_id, r.chunk_ord, r.text, r.breadcrumb) for r in df.collect())
    got = spark.sql("SELECT doc_id, c.* FROM documents_sql, LATERAL chunk(text) AS c")
    assert key(got) == key(chunking.chunk_documents(docs))
    few = spark.sql("SELECT doc_id, c.* FROM documents_sql, LATERAL chunk(text, 200, 0) AS c")
    assert key(few) == key(chunking.chunk_documents(docs, 200, 0))
    raw = spark.createDataFrame([("/a.md", b"x"), ("/b.zzz", b"y"), ("/c.docx", b"z"), (None, None)], "path string, content binary")
    raw.createOrReplaceTempView("raw_files")
    got = spark.sql("SELECT path, e.* FROM raw_files, LATERAL extract(path, content) AS e")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, files.extract(raw).collect()), key=repr)
    parts = spark.sql("SELECT * FROM documents_sql, LATERAL diff_lines(text, NULL) AS d WHERE doc_id = 1")
    assert parts.count() == 1


def test_each_text_is_embedded_once(spark, tmp_path):
    root, log = f"file://{tmp_path}/memo", tmp_path / "calls"
    log.mkdir()

    def provider(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [None if t == "none" else [float(len(t)), 1.0] for t in texts]

    rows = [(i, ["one", "two", "two", "", None, " ", "none", "bad"][i % 8], [9.0] if i == 0 else None) for i in range(64)]
    chunks = spark.createDataFrame(rows, "chunk_ord int, text string, embedding array<double>").repartition(4)
    out, counts = memo.reindex(chunks, root, "m", provider, batch=1)
    assert tuple(counts.first()) == (64, 39, 4, 0, 2, 2)
    got = {r.chunk_ord: r.embedding for r in out.collect()}
    assert got[0] == [9.0] and all(got[i] == {0: [3.0, 1.0], 1: [3.0, 1.0], 2: [3.0, 1.0]}.get(i % 8) for i in range(1, 64))
    said = sorted(p.read_text() for p in log.iterdir())
    assert said == ["bad", "none", "one", "two"]
    out, counts = memo.reindex(chunks, root, "m", provider, force=True, batch=1)
    assert tuple(counts.first()) == (64, 40, 4, 2, 0, 2) and {r.chunk_ord: r.embedding for r in out.collect()}[0] == [3.0, 1.0]
    assert sorted(p.read_text() for p in log.iterdir()) == ["bad", "bad", "none", "none", "one", "two"]
    assert tuple(memo.reindex(chunks, root, "other", provider, batch=1)[1].first())[3:] == (0, 2, 2)
    assert memo.reindex(chunks.limit(0), root, "m", provider)[0].count() == 0


def test_hashed_tokens():
    a, b = memo.hashed_tokens(64)(["Ab ab gate", ""])
    assert sum(x * x for x in a) == pytest.approx(1) and b == [0.0] * 64 and max(a) == pytest.approx(2 / 5**0.5)
