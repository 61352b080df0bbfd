"""Event logs: tails, statistics, signal measures, question logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import scan


def trace_tail(events: DataFrame, kind: str, limit: int = 50) -> DataFrame:
    return events.filter(F.col("kind") == kind).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def trace_stats(events: DataFrame, kinds: list[str] | None = None, newest: int | None = None) -> DataFrame:
    """kind, n, secs, tokens, ok, err, last_ts, avg_secs; of each kind the newest events only, if so many are named. tokens is
    0 where events have none."""
    rows = events if kinds is None else events.filter(F.col("kind").isin(kinds))
    if newest is not None:
        rows = scan.newest(rows, ["kind"], [F.col("ts").desc()], newest)
    ok = F.col("status").isin("ok", "done")
    spent = F.coalesce(F.sum("tokens"), F.lit(0)).cast("long") if "tokens" in rows.columns else F.lit(0).cast("long")
    out = rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("secs", F.lit(0.0))), 1).alias("secs"), spent.alias("tokens"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "error").alias("err"), F.max("ts").alias("last_ts"))
    return out.withColumn("avg_secs", F.round(F.col("secs") / F.col("n"), 2))


def lip_ratios(samples: DataFrame, by: str, pos: str, value: str, window: int, low: float, amp: float, reach: float) -> DataFrame:
    """by, frame, rms, ratio: the loudness of each frame of `window` samples, as a share of the loudest, raised to 0.7 and
    averaged with its neighbours' (silence beyond the ends), over the ratio `low` by at most `reach`."""
    frames = samples.groupBy(by, F.floor(F.col(pos) / window).alias("frame")).agg(F.sqrt(F.avg(F.col(value).cast("double") * F.col(value))).alias("rms"))
    top = F.max("rms").over(Window.partitionBy(by))
    share = F.when(top > 1e-6, F.col("rms") / top).otherwise(F.col("rms"))
    loud = frames.withColumn("loud", F.pow(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), 0.7))
    smooth = smoothed_envelope(loud, by, ["frame"], "loud")
    most = max(low, min(1.0, low + reach))
    return smooth.select(by, "frame", "rms", F.least(F.greatest(low + amp * F.col("smooth"), F.lit(low)), F.lit(most)).alias("ratio"))


def qa_add(log: DataFrame, records: DataFrame, keep: int = 500) -> DataFrame:
    """The log with records; the newest `keep` by id remain."""
    return log.unionByName(records, allowMissingColumns=True).orderBy(F.col("id").desc()).limit(keep)


def qa_clear(log: DataFrame, before: int | None = None) -> DataFrame:
    """An empty log, or one without the records of smaller id."""
    return log.limit(0) if before is None else log.filter(F.col("id") >= before)


def qa_export(log: DataFrame) -> DataFrame:
    """id, text: each record as a question and its answer in markdown."""
    return log.select("id", F.concat(F.lit("**"), F.coalesce("question", F.lit("")), F.lit("**\n\n"), F.coalesce("answer", F.lit(""))).alias("text"))


def motion_peaks(frames: DataFrame, by: str, order: list[str], value: str, control: str, above: float = 1.5) -> DataFrame:
    """by, n, peak, low, mean, peaks: absolute differences of neighbours, and how many exceed the control's mean by `above`."""
    d = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))
    rows = frames.select(by, d.alias("_d")).filter(F.col("_d").isNotNull())
    base = rows.filter(F.col(by) == control).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("_m"))
    return rows.crossJoin(F.broadcast(base)).groupBy(by).agg(F.count("*").alias("n"), F.max("_d").alias("peak"), F.min("_d").alias("low"), F.avg("_d").alias("mean"), F.count_if(F.col("_d") > F.col("_m") + above).alias("peaks"))


def smoothed_envelope(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """rows with smooth: the sum of a value and its neighbours over 3; beyond the ends is silence."""
    w = Window.partitionBy(by).orderBy(*order)
    at = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.withColumn("smooth", (at(F.lag(value).over(w)) + F.col(value) + at(F.lead(value).over(w))) / 3)


def history_last(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    r = T.spare(turns, "r")
    return turns.withColumn(r, F.row_number().over(w)).filter(F.col(r) <= n).drop(r)


def history_parse(col):
    """`q|a && q|a` (or a line each) as an array of the last three (q, a); the full-width bar counts too."""
    parts = F.filter(F.split(F.translate(col, "｜", "|"), r"&&|\n"), lambda x: F.trim(F.split(x, r"\|")[0]) != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3)
    return F.transform(last, lambda x: F.struct(F.trim(F.split(x, r"\|")[0]).alias("q"), F.trim(F.coalesce(F.get(F.split(x, r"\|", 2), F.lit(1)), F.lit(""))).alias("a")))


def qa_digest(turns: DataFrame) -> DataFrame:
    """conv_id, digest: all turns in order, as they are put before a model that sums them up."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("："), x.text)), "\n").alias("digest"))


def qa_log(turns: DataFrame, keep: int = 500, show: int = 200) -> DataFrame:
    """conv_id, turn, question, answer of the newest questions: a user's turn and the assistant's next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("answer", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))).filter("role = 'user'")
    return pairs.select("conv_id", "turn", F.col("text").alias("question"), "answer").orderBy(F.col("conv_id").desc(), F.col("turn").desc()).limit(min(keep, show))


def agent_stats(runs: DataFrame) -> DataFrame:
    """id, actions, tool_steps of agent runs with steps of (type, action)."""
    tools = F.filter("steps", lambda s: s.type == "tool")
    return runs.select("id", F.array_sort(F.array_distinct(F.transform(tools, lambda s: s.action))).alias("actions"), F.size(tools).alias("tool_steps"))


def compact_history(log: DataFrame, by: str, keep: int = 500) -> DataFrame:
    """The newest `keep` records of each key, however many it has."""
    return scan.newest(log, [by], [F.col("ts").desc()], keep)
