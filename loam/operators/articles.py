"""Articles as documents of a knowledge base: every line says by itself what it is about. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T

# Fixed values ---------------------------------------------------------------------------------------------------------
IMAGE = r"!\[([^\]]*)\]\([^)]*\)"
PICTOGRAPHS = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{FE0F}]"
RULES = ("---", "***", "___")
DIVIDERS = ("", "---", ":---", "---:")
#: What a line loses or changes, in order.
INLINE = [(PICTOGRAPHS, ""), (r"<([^<>\n]{1,40})>", "「$1」"), (r"\*\*(.+?)\*\*", "$1"), ("`", ""), (r"[ \t]{2,}", " "), (r"\s+$", "")]
# ----------------------------------------------------------------------------------------------------------------------


def inline(line) -> Column:
    """A line without bold marks, code marks and pictographs; <x> becomes 「x」, so that no cleaning takes it for a tag."""
    return T.stepwise(line, INLINE)


def row_sentence(line, prefix) -> Column:
    """A table row as `【prefix】first：second｜third。`; null for rows of less than two cells."""
    cells = F.filter(F.transform(F.split(F.regexp_replace(T.strip(line), r"^\|+|\|+$", ""), r"\|", -1), T.strip), lambda c: ~c.isin(*DIVIDERS))
    cells = F.transform(cells, inline)
    rest = F.array_join(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), "｜")
    return F.when(F.size(cells) > 1, F.concat(F.lit("【"), prefix, F.lit("】"), cells[0], F.lit("："), rest, F.lit("。")))


def without_front_matter(lines) -> Column:
    """Lines after the front matter, if the first line opens one and a later line closes it."""
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    close = F.array_position(F.transform(rest, T.strip), F.lit("---"))
    tail = F.slice(rest, (close + 1).cast("int"), F.size(rest))
    return F.when((T.strip(F.get(lines, F.lit(0))) == "---") & (close > 0), tail).otherwise(lines)


def article_lines(articles: DataFrame, signatures: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, body (lines), figures (captions) of articles (doc_id, text, breadcrumb, prefix).

    Front matter, empty lines, rules, fences, level-1 headings and lines with a signature go; lines that are an image become
    captions; the first row of a table goes and the others become sentences with the prefix; other headings carry the
    breadcrumb. Null text gives no lines."""
    raw = without_front_matter(F.split(F.coalesce("text", F.lit("")), T.LINE_BREAK, -1))
    image = lambda x: F.rlike(x, F.lit(rf"^\s*{IMAGE}\s*$"))
    gone = lambda x: (T.strip(x) == "") | T.strip(x).isin(*RULES) | F.startswith(x, F.lit("# ")) | F.startswith(T.strip(x), F.lit("```")) | sum((F.contains(x, F.lit(s)).cast("int") for s in signatures), F.lit(0)).cast("boolean")
    rows = articles.select("doc_id", "breadcrumb", "prefix", F.filter(raw, lambda x: ~gone(x)).alias("l"))
    rows = rows.withColumn("figures", F.filter(F.transform(F.filter("l", image), lambda x: T.strip(F.regexp_extract(x, IMAGE, 1))), lambda x: x != ""))
    rows = rows.withColumn("l", F.filter("l", lambda x: ~image(x)))
    table = lambda x: F.startswith(T.strip(x), F.lit("|"))

    def line(x, i):
        text = inline(F.regexp_replace(x, IMAGE, "（配图：$1）"))
        header = (i == 0) | ~table(F.get("l", i - 1))
        return (
            F.when(table(x) & header, None)
            .when(table(x), row_sentence(x, F.col("prefix")))
            .when(T.strip(text) == "", None)
            .when(F.startswith(F.ltrim(text), F.lit("#")), F.concat(F.lit("### 【"), F.col("breadcrumb"), F.lit("】"), T.strip(F.regexp_replace(text, r"^#{1,6}\s*", ""))))
            .when(F.startswith(T.strip(x), F.lit(">")), T.strip(F.replace(text, F.lit(">"), F.lit(""))))
            .otherwise(text)
        )

    return rows.select("doc_id", F.filter(F.transform("l", line), lambda x: x.isNotNull()).alias("body"), "figures")


def article_document(articles: DataFrame, app: str, version: str, origin: str, signatures: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text of articles (doc_id, text, title, prefix, summary, keywords, faqs array<struct<q,a>>): heading, summary,
    keywords, version and origin, questions, body and captions. Null parts are empty."""
    place = F.concat(F.lit(f"{app}·"), F.coalesce("title", F.lit("")))
    made = article_lines(articles.select("doc_id", "text", place.alias("breadcrumb"), F.coalesce("prefix", F.lit("")).alias("prefix")), signatures)
    d = articles.select("doc_id", "title", "summary", "keywords", "faqs", place.alias("place")).join(made, "doc_id")
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    part = lambda name: F.array(F.concat(F.lit("### 【"), F.col("place"), F.lit(f"】{name}")), F.lit(""))
    blank = F.array(F.lit(""))
    faqs = F.flatten(F.transform("faqs", lambda f, i: F.array(F.concat(F.lit("问"), (i + 1).cast("string"), F.lit("："), f.q), F.concat(F.lit("答"), (i + 1).cast("string"), F.lit("："), f.a), F.lit(""))))
    captions = F.when(F.size("figures") > 0, F.concat(blank, part("配图清单"), F.transform("figures", lambda x: F.concat(F.lit("- 配图："), x)))).otherwise(F.array().cast("array<string>"))
    source = F.concat(F.lit(f"来源：{origin}"), F.when(F.size("figures") > 0, "配图见文末「配图清单」。").otherwise(""))
    head = F.array(F.concat(F.lit(f"# 【{app}】"), said("title")), F.lit(""), F.concat(F.lit("概览摘要："), said("summary")), F.concat(F.lit("关键词："), said("keywords")), F.lit(f"适用版本：{version}"), source, F.lit(""))
    out = F.concat(head, part("常见问题速查"), F.coalesce(faqs, F.array().cast("array<string>")), part("正文内容"), F.col("body"), captions, blank)
    return d.select("doc_id", F.array_join(out, "\n").alias("text"))


def article_index(articles: DataFrame) -> DataFrame:
    """doc_id, ord, line: the entries of an index of articles (doc_id, title, category, summary, faqs): one that sums the
    article up (ord 0) and one for each of its questions. Rows, not one text: a reader's index is written in their order."""
    entry = F.concat(F.lit("条目【"), F.col("title"), F.lit("】（分类："), F.col("category"), F.lit("）："), F.col("summary"))
    asked = F.transform(F.coalesce("faqs", F.array().cast("array<struct<q:string,a:string>>")), lambda f: F.concat(F.lit("若被问到「"), f.q, F.lit("」，参见条目【"), F.col("title"), F.lit("】。")))
    return articles.select("doc_id", F.posexplode(F.concat(F.array(entry), asked)).alias("ord", "line"))
