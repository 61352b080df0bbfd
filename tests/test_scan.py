"""The two-level prefix scan against window functions over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.operators import scan


def frame(spark, kinds, many=3000):
    rng = random.Random(len(kinds))
    rows = [(rng.choice(kinds), rng.randrange(400), i, rng.choice([None, *range(9)])) for i in range(many)]
    return spark.createDataFrame(rows, "k string, t int, id int, v long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kinds", [["a"], ["a", None], ["a", "b", "c", None], [str(i) for i in range(500)]])
def test_equals_windows(spark, kinds):
    df = frame(spark, kinds).repartition(7)
    order = [F.col("t").desc(), "id"]
    w = Window.partitionBy("k").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.row_number().over(w).cast("long").alias("nth"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("b"), F.last("v", True).over(upto).alias("l"), F.lag("v").over(w).alias("g"))
    got = scan.prefix(df, ["k"], order, number="nth", sums={"s": "v"}, befores={"b": F.col("v")}, lasts={"l": "v"}, lags={"g": "v"})
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_no_task_holds_a_key(spark, monkeypatch):
    """One key is dealt to all ranges, and each has some rows."""
    held, write = [], scan.written
    monkeypatch.setattr(scan, "written", lambda df, name: held.append(write(df, name)) or held[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        df = scan.prefix(frame(spark, ["a"], 20000), ["k"], ["t", "id"], number="nth")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in held[0].groupBy("scan_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 8000
    assert sorted(r.nth for r in df.collect()) == list(range(1, 20001))


def test_numbered_newest_take_while(spark):
    df = frame(spark, ["a", "b", None])
    assert sorted(r.place for r in scan.numbered(df, ["t", "id"]).collect()) == list(range(1, 3001))
    order = [F.col("t").desc(), "id"]
    w = Window.partitionBy("k").orderBy(*order)
    assert rows(scan.newest(df, ["k"], order, 50)) == rows(df.withColumn("r", F.row_number().over(w)).filter("r <= 50").drop("r"))
    before = F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    assert rows(scan.take_while(df, ["k"], order, F.col("v"), 100)) == rows(df.withColumn("u", before).filter("u <= 100").drop("u"))


def test_asof(spark):
    rng = random.Random(3)
    marks = [(rng.choice(["a", None]), rng.randrange(1000), i) for i in range(200)] + [("a", None, 7)]
    asked = [(rng.choice(["a", "b", None]), rng.randrange(-50, 1100), i) for i in range(900)] + [("a", None, 1)]
    got = scan.asof(spark.createDataFrame(asked, "k string, at int, id int"), spark.createDataFrame(marks, "k string, at int, mark int"), ["k"], "at", "mark")

    def last(k, t):
        held = [(a, m) for kk, a, m in marks if kk == k and a is not None and t is not None and a <= t]
        return max(held)[1] if held else None

    assert rows(got.select("k", "at", "id", "mark")) == sorted(((k, t, i, last(k, t)) for k, t, i in asked), key=repr)


def test_odd_input(spark):
    df = frame(spark, ["a", None], 50)
    clash = df.select("*", *[F.lit(1).alias(f"scan_{x}") for x in ("part", "nth", "tie", "end", "p", "s0", "key0")])
    out = scan.prefix(clash, ["k"], ["t"], number="nth", sums={"s": "v"})
    assert out.columns == [*clash.columns, "nth", "s"] and out.count() == 50 and {r.scan_part for r in out.collect()} == {1}
    assert scan.prefix(df.limit(0), ["k"], ["t"], number="nth").count() == 0
