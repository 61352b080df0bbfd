"""Rebuilds over tables whose vectors and texts have copies."""

import os

import pytest

TEXTS = ["a text of some length", "a text of some length ", "short", "another text of some length", None, "", "third text, as long", "short", "a text of some length"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("copies"))
    n = len(TEXTS)
    spark.createDataFrame([(i, t, "en" if i % 2 else None, f"src{i % 3}") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(n - 2)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["rebuild_stats", "rebuild_near", "exact_dedup"])
def test_as_its_sql(spark, tables, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(tables):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tables}/{f}/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, tables)
    assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_texts_are_in_no_aggregate(spark):
    from loam.operators import corpus

    d = spark.createDataFrame([(1, "a", "s"), (2, "a ", "t")], "chunk_ord long, text string, source string")
    kept = corpus.exact_dedup(d)
    assert "min_by" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in kept.collect()] == [(1, "a", "s", ["s", "t"])]
