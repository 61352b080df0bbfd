"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

State is a set of runs: Parquet tables of (h1, h2, n), sorted by hash, n being the number of documents that hold a line.
A new batch is reduced to its distinct line hashes and their counts, merge-anti-joined with what all runs together have
over the threshold (those lines need no more counting) and written as a run of level 0. When a level holds `fanout` runs
they are merged into one run of the next level.

Texts are parsed once into a table of line hashes with their places; the batches, and later the places of the lines that
go, are read from it. What stays of a text is put together from the stretches between the places that go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.shared import ascii_lower, bounded, few_files, scratch, spare, table, texts, written

WHITE = " \t\n\x0b\x0c\r"


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def key_hash(key):
    """128 bits; the two halves come from different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(77), key).alias("h2")]


def lines_of(text):
    return F.split(text, "\n", -1)


def row_hash(doc_id: str = "doc_id", text: str = "text"):
    """128 bits of a row. Rows that share them have the same doc_id and text, and so the same lines to lose."""
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit(77), text, doc_id).alias("r2")]


def line_places(docs: DataFrame) -> DataFrame:
    """r1, r2, h1, h2, place, first: each line of at least one character of each row of docs (doc_id, text) by the hash of
    its key, with its place in the text and whether it is the first of its key there."""
    keyed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("place")))
    hashed = F.transform(F.filter(keyed, lambda x: x.key != ""), lambda x: F.struct(*key_hash(x.key), x.place.alias("place")))
    # Sorted, equal keys are neighbours.
    rows = docs.select(*row_hash(), F.array_sort(hashed).alias("ls"))
    before = lambda i: F.get("ls", i - 1)
    marked = F.transform("ls", lambda x, i: F.struct(x.h1.alias("h1"), x.h2.alias("h2"), x.place.alias("place"), ((i == 0) | (x.h1 != before(i).h1) | (x.h2 != before(i).h2)).alias("first")))
    return rows.select("r1", "r2", F.inline(marked))


class LineRuns:
    """Incremental document counts of lines."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4, state: dict | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        state = state or {"root": scratch(spark, "line-runs"), "levels": {}, "made": 0}
        self.root, self.made = state["root"], state["made"]
        self.levels: dict[int, list[str]] = {int(k): list(v) for k, v in state["levels"].items()}

    def state(self) -> dict:
        """What another session needs to go on: LineRuns(spark, state=...)."""
        return {"root": self.root, "levels": self.levels, "made": self.made}

    def _write(self, runs: DataFrame) -> str:
        self.made += 1
        path = f"{self.root}/run-{self.made}"
        few_files(runs).sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def counts(self) -> DataFrame:
        """h1, h2, n of all lines that the runs hold, merged. A line counted off once it had reached min_docs stays so."""
        runs = [p for paths in self.levels.values() for p in paths]
        held = self.spark.read.schema("h1 long, h2 long, n long")
        return (held.parquet(*runs) if runs else self.spark.createDataFrame([], "h1 long, h2 long, n long")).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def add(self, docs: DataFrame) -> None:
        """One batch of documents (doc_id, text) becomes one run of level 0; full levels are compacted. An empty batch
        becomes an empty run; null texts count as empty and have no lines to count."""
        self.add_lines(line_places(texts(docs)))

    def add_lines(self, places: DataFrame) -> None:
        """add() for a batch that line_places() gave."""
        fresh = places.filter("first").groupBy("h1", "h2").agg(F.count("*").alias("n"))
        if self.levels:
            # Both sides by hash and in its order: a merge.
            fresh = fresh.join(self.frequent().hint("merge"), ["h1", "h2"], "left_anti")
        self.levels.setdefault(0, []).append(self._write(fresh))
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self.compact(level)
            level += 1

    def unseen(self, docs: DataFrame) -> DataFrame:
        """(h1, h2) of the lines of docs that no run holds yet; without lines or documents, none."""
        fresh = line_places(texts(docs)).select("h1", "h2").distinct()
        return fresh.join(self.counts().hint("merge"), ["h1", "h2"], "left_anti")

    def compact(self, level: int) -> None:
        """The runs of a level become one of the next; empty runs add nothing to it."""
        paths = self.levels.pop(level)
        merged = self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        self.levels.setdefault(level + 1, []).append(self._write(merged))

    def frequent(self) -> DataFrame:
        """(h1, h2) of all lines that at least min_docs documents hold; none while there are no runs."""
        return self.counts().filter(F.col("n") >= self.min_docs).select("h1", "h2")


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, text, kept_text, n_lines, n_dropped for every row of docs; other columns ride along, save those names.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least one character
    in at least min_docs rows lose all their lines. Null text counts as empty (one empty line, which is kept); a text
    that loses every line becomes empty; repeated rows count as documents of their own; an empty table gives no rows.
    The documents arrive as `batches` batches by hash, as they would day by day; the result doesn't depend on that.
    """
    base = docs.drop("kept_text", "n_lines", "n_dropped").withColumn("text", F.coalesce("text", F.lit("")))
    places = written(line_places(base.select("doc_id", "text")), "line-places")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    batch = F.pmod(F.xxhash64("r1", "r2"), F.lit(batches))
    for b in range(batches):
        runs.add_lines(places.filter(batch == b))
    r1, r2, gone = (spare(base, x) for x in ("r1", "r2", "gone"))
    # Repeated rows have one set of places.
    hits = places.join(bounded(runs.frequent()), ["h1", "h2"]).groupBy("r1", "r2").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    named = hits.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("gone").alias(gone))
    one, two = row_hash()
    held = base.withColumns({r1: one, r2: two}).join(named, [r1, r2], "left")
    lines = lines_of(F.col("text"))
    none = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    # Stretches between the places that go: before the first, after each one up to the next, and after the last.
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(gone, j - 1) + 1)
    end = lambda j: F.coalesce(F.get(gone, j), F.size(lines))
    stretches = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(lines, start(j) + 1, end(j) - start(j)))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.flatten(stretches)))
    return held.select(*base.columns, kept.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.size(none).cast("long").alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = r"""
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, pos, line, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key)
"""
SQL = f"""
WITH {LINES_SQL.format(docs="documents")}
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
