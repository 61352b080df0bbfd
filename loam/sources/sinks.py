"""Stores, backups, products."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.files import load_store

SCHEMA_VERSION = 1


def write_store(chunks: DataFrame, path: str) -> None:
    """Rewrites the stores (kb) that chunks holds, through a staging folder: what is read is never overwritten."""
    spark = chunks.sparkSession
    stage = path.rstrip("/") + "_stage"
    chunks.write.mode("overwrite").partitionBy("kb").parquet(stage)
    spark.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb").parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(stage)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def backup(chunks: DataFrame, path: str) -> dict:
    """Parquet, a manifest of schema, version and counts, and a table of the sources of each store."""
    chunks.write.mode("overwrite").partitionBy("kb").parquet(f"{path}/chunks")
    per = [(r.kb, r.n) for r in chunks.groupBy("kb").agg(F.count("*").alias("n")).orderBy("kb").collect()]  # a row a store
    if "source" in chunks.columns:
        chunks.groupBy("kb", "source").agg(F.count("*").alias("chunks")).write.mode("overwrite").parquet(f"{path}/sources")
    manifest = {"version": SCHEMA_VERSION, "chunk_total": sum(n for _, n in per), "stores": dict(per), "schema": json.loads(chunks.schema.json())}
    chunks.sparkSession.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str, current: DataFrame | None = None, merge: bool = True) -> DataFrame:
    """The backed-up stores, with those of current that the backup doesn't hold if merge is on. A path that ends in .json is
    one store as a JSON document, the oldest form of a backup."""
    saved = load_store(spark, path)[0] if path.endswith(".json") else spark.read.parquet(f"{path}/chunks")
    if current is None or not merge:
        return saved
    return saved.unionByName(current.join(saved.select("kb").distinct(), "kb", "left_anti"), allowMissingColumns=True)


def numbered(rows: DataFrame, order: str, line) -> DataFrame:
    """One row, text: the lines in order, by newlines: a product is a document for a reader."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x.l), "\n").alias("text"))


def _headed(head: str, body: DataFrame, tail: str = "") -> DataFrame:
    return body.select(F.concat(F.lit(head), F.col("text"), F.lit(tail)).alias("text"))


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def report(sections: DataFrame, topic: str, hits: int, at: str) -> DataFrame:
    """sections: ord, title, body; hits: of how many pieces the report is made, at: when."""
    body = numbered(sections, "ord", F.concat(F.lit("## "), _text("title"), F.lit("\n\n"), _text("body"), F.lit("\n")))
    return _headed(f"# {topic} · 分析报告\n\n> 生成时间：{at}　|　来源：本地知识库（{hits} 条片段）\n\n", body)


def quiz(items: DataFrame, topic: str) -> DataFrame:
    """items: ord, question, options, answer, explain (null or empty: no line)."""
    options = F.array_join(F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    why = F.when(_text("explain") != "", F.concat(F.lit("- 解析："), F.col("explain"), F.lit("\n"))).otherwise("")
    return _headed(f"# {topic} · 测验题\n\n", numbered(items, "ord", F.concat(F.lit("## "), F.col("ord").cast("string"), F.lit(". "), _text("question"), F.lit("\n"), options, F.lit("- **答案**："), _text("answer"), F.lit("\n"), why)))


def flashcards(items: DataFrame, topic: str) -> DataFrame:
    """items: ord, front, back."""
    return _headed(f"# {topic} · 记忆卡片\n\n", numbered(items, "ord", F.concat(F.lit("## "), F.col("ord").cast("string"), F.lit(". "), _text("front"), F.lit("\n- "), _text("back"), F.lit("\n"))))


def mindmap(nodes: DataFrame, topic: str) -> DataFrame:
    """nodes (ord, depth from 1, label) below the topic as a mermaid mind map and as an outline."""
    tree = numbered(nodes, "ord", F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), _text("label"))).select(F.col("text").alias("tree"))
    outline = numbered(nodes, "ord", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), _text("label")))
    end = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat(F.lit("\n"), F.col(c)))
    head = f"# {topic} · 思维导图\n\n## 中心主题\n- **{topic}**\n\n```mermaid\nmindmap\n  root(({topic}))"
    return tree.crossJoin(outline).select(F.concat(F.lit(head), end("tree"), F.lit(f"\n```\n\n## 文本大纲\n- {topic}"), end("text")).alias("text"))  # one row each


def markdown_table(rows: DataFrame, order: str, columns: list[str], topic: str) -> DataFrame:
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_text(c) for c in columns]), F.lit(" |"))
    head = f"# {topic} · 数据表\n\n| {' | '.join(columns)} |\n|{'|'.join(['---'] * max(1, len(columns)))}|\n"
    return _headed(head, numbered(rows, order, line))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The columns with a header line, quoted where needed, quotes doubled; any number of files."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def podcast(scripts: DataFrame) -> DataFrame:
    """topic, text, takes of scripts (topic, script): the script as a document, and what is spoken at a time: four lines each of
    those over 12 characters that are no headings; the beginning of the script where there are none."""
    spoken = F.filter(F.transform(F.split(_text("script"), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (F.char_length(x) > 12) & ~F.startswith(x, F.lit("#")))
    rows = scripts.select("topic", _text("script").alias("script"), spoken.alias("l"))
    take = lambda k: F.array_join(F.slice("l", k * 4 + 1, 4), " ")
    takes = F.when(F.size("l") == 0, F.array(F.substring("script", 1, 800))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 4).cast("int")), take))
    return rows.select("topic", F.concat(F.lit("# "), F.col("topic"), F.lit(" · 播客讲稿\n\n"), F.col("script"), F.lit("\n")).alias("text"), takes.alias("takes"))
