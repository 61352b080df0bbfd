"""Running values over keys of any size: a prefix scan on two levels.

A window over a key that holds a third of all rows is one task. Here rows are dealt into ranges of (key, order), each range
is scanned for itself, and what a key's earlier ranges come to is carried into the next: a range begins within one key at
most, so that there is one row of carry for each range, however many rows and keys there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.text import spare
from loam.sources.scratch import written


def prefix(df: DataFrame, by: list[str], order: list, number: str | None = None, sums: dict | None = None, befores: dict | None = None, lasts: dict | None = None, lags: dict | None = None) -> DataFrame:
    """df with running columns along `order` within each key `by` (none: over all rows).

    number: the row's place, from 1. sums: name -> what is added up to and with the row. befores: the same without the row.
    lasts: the last value that is not null, at the row or before. lags: the previous row's value. Null keys are a key; null
    summands count as nothing, sums of nothing are 0; rows that `order` does not tell apart go by a hash of their columns.
    The result equals window functions over the key, but for the order in which doubles are added. An empty table stays
    empty; columns named like new ones are replaced.
    """
    sums, befores, lasts, lags = (dict(x or {}) for x in (sums, befores, lasts, lags))
    new = [*([number] if number else []), *sums, *befores, *lasts, *lags]
    names: dict[str, str] = {}

    def helper(name: str) -> str:
        if name not in names:
            names[name] = spare(df, f"scan_{name}")
        return names[name]

    part, nth, tie, end = (helper(x) for x in ("part", "nth", "tie", "end"))
    given = {f"{kind}{i}": (name, value) for kind, group in (("s", sums), ("b", befores), ("l", lasts), ("g", lags)) for i, (name, value) in enumerate(group.items())}
    hashed = [c.name for c in df.schema.fields if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    # A value that is a column of df is not copied.
    source = {x: v if isinstance(v, str) else helper(x) for x, (_, v) in given.items()}
    keyed = df.withColumns({tie: F.xxhash64(*hashed)} | {source[x]: v for x, (_, v) in given.items() if not isinstance(v, str)})
    order = [*order, tie]
    dealt = keyed.repartitionByRange(*by, *order) if by or order else keyed
    local = Window.partitionBy(part, *by).orderBy(*order)
    upto, before, all_rows = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1), local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = {nth: F.row_number().over(local).cast("long"), end: F.count("*").over(all_rows)}
    for x in given:
        value = F.col(source[x])
        run |= {helper(x + "run"): {"s": lambda v: F.sum(v).over(upto), "b": lambda v: F.sum(v).over(before), "l": lambda v: F.last(v, True).over(upto), "g": lambda v: F.lag(v).over(local)}[x[0]](value)}
    held = written(dealt.withColumn(part, F.spark_partition_id()).withColumns(run), "ranges")
    # The last row of a key's range tells what the range comes to; the ranges before are added up.
    totals = {"n": F.col(nth)}
    for x in given:
        own, ran = F.col(source[x]), F.col(helper(x + "run"))
        totals[x] = {"s": ran, "b": F.coalesce(ran + own, ran, own), "l": ran, "g": own}[x[0]]
    ends = held.filter(F.col(nth) == F.col(end)).select(F.col(part), *by, *[v.alias(helper(f"{x}_total")) for x, v in totals.items()])
    keys = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = keys.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = {x: (F.last(F.col(helper(f"{x}_total")), x[0] == "l") if x[0] in "lg" else F.sum(helper(f"{x}_total"))).over(earlier) for x in totals}
    carry = ends.select(F.col(part).alias(helper("p")), *[F.col(c).alias(helper(f"key{i}")) for i, c in enumerate(by)], *[v.alias(helper(f"{x}_carry")) for x, v in carried.items()])
    carry = carry.filter(F.col(helper("n_carry")).isNotNull())
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(helper(f"key{i}"))) for i, c in enumerate(by)], F.col(part) == F.col(helper("p")))
    both = held.join(F.broadcast(carry), same, "left")  # a row for each range at most
    out = {number: F.col(nth) + F.coalesce(helper("n_carry"), F.lit(0))} if number else {}
    for x, (name, _) in given.items():
        ran, before = F.col(helper(x + "run")), F.col(helper(f"{x}_carry"))
        out[name] = F.coalesce(before + ran, before, ran, F.lit(0)) if x[0] in "sb" else F.coalesce(ran, before) if x[0] == "l" else F.when(F.col(nth) == 1, before).otherwise(ran)
    return both.select(*[c for c in df.columns if c not in new], *[v.alias(k) for k, v in out.items()])


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with each row's place in the whole table, from 1; no task sorts more than a range."""
    return prefix(df, [], order, number=name)


def newest(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key in `order`, however large a key is."""
    nth = spare(df, "nth")
    return prefix(df, by, order, number=nth).filter(F.col(nth) <= n).drop(nth)


def take_while(df: DataFrame, by: list[str], order: list, length, limit: int) -> DataFrame:
    """Rows of each key while what came before is within the limit."""
    used = spare(df, "used")
    return prefix(df, by, order, befores={used: length}).filter(F.col(used) <= limit).drop(used)


def asof(asked: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """asked with `value` of the last of marks (by, at, value; ties: the greatest value) at or before its own `at`; null
    before the first. Rows of a null `at` find nothing, marks of a null one aren't found."""
    kind, seen, row = (spare(asked, x) for x in ("kind", "seen", "row"))
    rest = [c for c in asked.columns if c not in (*by, at, value)]
    left = asked.select(*by, at, F.lit(1).alias(kind), F.lit(None).cast(marks.schema[value].dataType).alias(seen), F.struct(*rest).alias(row) if rest else F.lit(None).alias(row))
    right = marks.filter(F.col(at).isNotNull()).select(*by, at, F.lit(0).alias(kind), F.col(value).alias(seen), F.lit(None).cast(left.schema[row].dataType).alias(row))
    both = prefix(left.unionByName(right), by, [at, kind, seen], lasts={value: seen}).filter(F.col(kind) == 1)
    return both.select(*by, at, *[F.col(f"{row}.{c}") for c in rest], value)
