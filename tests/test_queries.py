"""Every registered query of the reference's operators against its DuckDB oracle, at sf0.001."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(float(v), 5) if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def names():
    return sorted(every()[1])


def every():
    """The registered queries, and the checks over rows written out by hand."""
    from loam.plans.catalog import LITERAL, LITERAL_SQL, ORACLE_SQL, QUERIES

    return QUERIES | LITERAL, ORACLE_SQL | LITERAL_SQL


@pytest.mark.parametrize("name", names())
def test_matches_oracle(spark, duck, name):
    queries, oracles = every()
    df = queries[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(oracles[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(dict(zip(want.columns, r))[c]) for c in cols) for r in want.fetchall()), key=repr)


def test_others_give_rows(spark):
    from loam.plans.catalog import ORACLE_SQL, QUERIES

    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
