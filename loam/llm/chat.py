"""Multi-party perspective rotation of dialogues (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.shared import table, written

#: A dialogue whose texts, with MARKS characters for each turn, come to more than so many is rendered in parts, since one row
#: can't hold it.
PART_CHARS, MARKS = 1 << 26, 64


def escaped(col):
    """Turn markers inside a text or a name can't forge turns."""
    return F.replace(F.replace(col, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(turns: DataFrame, context: tuple[str, ...] = ("system",), part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, speaker, part, offset, n_turns, n_spans, rendered, spans: one row per conversation and participant.

    Turns are rendered `<|role|>` or `<|user:name|>`, newline, text, `<|end|>`, newline, in the order of turn (nulls
    first), then role, then text. The participants are the distinct roles but those of `context`, which keep their own
    name. Under each participant's perspective that speaker's turns are `assistant` and the other speakers' are named
    users. spans lists `start-end` character ranges (end exclusive, over rendered) of the assistant's texts with their
    end marker: the loss mask. Null text counts as empty. A turn of null or empty role is spoken by `unknown`, who is no
    participant. Null conv_id is a conversation of its own. A conversation without participants has no perspective and
    gives no row; an empty table gives none. Repeated rows are repeated turns. A dialogue of at most part_chars is whole,
    part 0 and offset 0. A longer one has a row for each part of it: a part ends where part_chars are reached, offset is the
    number of characters rendered before it, and its parts' texts, put one after the other, are the whole dialogue; spans
    count from the beginning of the part.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.when(F.col("role") == "", None).otherwise(F.col("role")), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    people = rows.filter((F.col("role") != "") & ~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    size = F.char_length("text").cast("long") + MARKS
    # At most one row for each part_chars of the whole table.
    long = written(rows.groupBy("conv_id").agg(F.sum(size).alias("chars")).filter(F.col("chars") > part_chars).select(F.col("conv_id").alias("long_id")), "long-dialogues", few=True)
    cut = not long.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    rows = _in_parts(rows, F.broadcast(long), same, size, part_chars) if cut else rows.withColumn("part", F.lit(0))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    name = lambda r: F.when(r == "", F.lit("unknown")).otherwise(escaped(r))
    shown = F.transform(
        "ts",
        lambda t: F.struct(
            (t.role == F.col("speaker")).alias("own"),
            F.concat(F.when(t.role == F.col("speaker"), F.lit("<|assistant|>\n")).when(t.role.isin(*context), F.concat(F.lit("<|"), escaped(t.role), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user:"), name(t.role), F.lit("|>\n")))).alias("head"),
            F.concat(escaped(t.text), F.lit("<|end|>")).alias("body"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        a = acc.at + F.char_length(t.head)
        b = a + F.char_length(t.body)
        span = F.when(t.own, F.array(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((b + 1).alias("at"), F.concat(acc.spans, span).alias("spans"))

    out = seen.withColumn("shown", shown).withColumn("mask", F.aggregate("shown", start, step))
    out = out.select("conv_id", "speaker", "part", F.size("ts").cast("long").alias("n_turns"), F.size("mask.spans").cast("long").alias("n_spans"), F.array_join(F.transform("shown", lambda t: F.concat(t.head, t.body, F.lit("\n"))), "").alias("rendered"), F.array_join("mask.spans", ",").alias("spans"))
    order = ["conv_id", "speaker", "part", "offset", "n_turns", "n_spans", "rendered", "spans"]
    if not cut:
        return out.withColumn("offset", F.lit(0).cast("long")).select(*order)
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lengths = out.select("conv_id", "speaker", "part", F.char_length("rendered").cast("long").alias("chars")).join(F.broadcast(long), same, "left_semi")
    starts = lengths.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("offset"))
    return out.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("part") == F.col("p")), "left").withColumn("offset", F.coalesce("offset", F.lit(0))).select(*order)


def _in_parts(rows: DataFrame, long: DataFrame, same, size, part_chars: int) -> DataFrame:
    """rows with part. The turns of long dialogues are range-partitioned by their order, so one dialogue has many tasks; a
    turn's place is what its partition holds before it plus what earlier partitions of its dialogue hold."""
    order = ["turn", "role", "text"]
    # Texts that begin alike share a range, so ranges are in the order of whole texts; bounds hold no long ones.
    dealt = rows.join(long, same, "left_semi").repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    dealt = written(dealt.withColumn("deal", F.spark_partition_id()).withColumn("chars", size), "long-turns")
    held = dealt.groupBy("conv_id", "deal").agg(F.sum("chars").alias("held"))
    earlier = Window.partitionBy("conv_id").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("conv_id").alias("c"), F.col("deal").alias("d"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("conv_id", "deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    placed = placed.join(held, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("deal") == F.col("d")))
    part = F.floor((F.col("before") + F.col("earlier")) / part_chars).cast("int")
    return placed.select("conv_id", *order, part.alias("part")).unionByName(rows.join(long, same, "left_anti").withColumn("part", F.lit(0)))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, 0 AS part, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') || '<|end|>' AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role NOT IN ('', 'system')),
h AS (SELECT t.*, p.speaker,
        CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' WHEN role = '' THEN '<|user:unknown|>'
             ELSE '<|user:' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' END || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, row_number() OVER w AS k,
        coalesce(sum(length(head) + length(body) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
      FROM h WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, speaker, part, 0::BIGINT AS "offset", count(*)::BIGINT AS n_turns, count(*) FILTER (role = speaker)::BIGINT AS n_spans,
       string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(body) AS BIGINT), ',' ORDER BY k) FILTER (role = speaker), '') AS spans
FROM o GROUP BY conv_id, speaker, part
"""
