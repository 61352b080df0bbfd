"""Queries of chunking over whole documents. The oracles cut texts by recursive SQL of their own, with patterns written out here."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import chunking as C
from loam.plans.retrieval_queries import table

Q: dict = {}
SQL: dict[str, str] = {}

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
HEAD = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
MARKER = r"^[ \t]*(\d+(\.\d+){1,3}\.?|(\d+|[IVX]{1,5})\.)[ \t]+\S.{0,200}$|^[ \t]*[A-ZÄÖÜ][A-ZÄÖÜ \-]{3,80}:?\s*$|^[ \t]*(-{3,}|={3,}|\*{3,}|_{3,})[ \t]*$"
UNIX = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def query(name: str, sql: str):
    def add(fn):
        Q[name] = fn
        SQL[name] = sql
        return fn

    return add


def cut(name: str, src: str, size: int, overlap: int) -> str:
    """Tables of a recursive WITH: `name` (doc_id, blk, ord, piece) of src (doc_id, blk, text), sentence by sentence."""
    full = f"length(held) + length(p[i + 1]) > {size}"
    return rf"""{name}_s AS (SELECT doc_id, blk, list_concat(regexp_extract_all(text, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+'), CASE WHEN regexp_matches(text, '[。！？!?；;\n]$') THEN [''] ELSE [] END) AS p FROM {src} WHERE trim(text, {BLANK}) <> ''),
{name}_f(doc_id, blk, i, held, done) AS (SELECT doc_id, blk, 1, p[1], CAST(NULL AS VARCHAR) FROM {name}_s UNION ALL
 SELECT doc_id, blk, i + 1, CASE WHEN {full} THEN right(held, {overlap}) ELSE held END || p[i + 1], CASE WHEN {full} THEN held END FROM {name}_f JOIN {name}_s USING (doc_id, blk) WHERE i < len(p)),
{name} AS (SELECT doc_id, blk, row_number() OVER (PARTITION BY doc_id, blk ORDER BY i, last) - 1 AS ord, piece FROM
 (SELECT doc_id, blk, i, false AS last, done AS piece FROM {name}_f WHERE done IS NOT NULL UNION ALL SELECT doc_id, blk, i, true, held FROM {name}_f JOIN {name}_s USING (doc_id, blk) WHERE i = len(p)) WHERE trim(piece, {BLANK}) <> '')"""


WHOLE = f"WITH RECURSIVE d AS (SELECT doc_id, 0 AS blk, {UNIX} AS text FROM documents), {cut('c', 'd', 500, 100)} "


@query("chunk_documents", WHOLE + "SELECT doc_id, ord::INT AS chunk_ord, piece AS text, '' AS breadcrumb FROM c")
def _(spark, sf):
    return C.chunk_documents(table(spark, sf, "documents"))


@query("chunk_recursive", WHOLE + "SELECT doc_id, ord::INT AS chunk_ord, piece AS text, '' AS breadcrumb FROM c")
def _(spark, sf):
    return C.chunk_documents(table(spark, sf, "documents"), strategy="recursive")


@query("chunk_parent_child", f"""WITH RECURSIVE d AS (SELECT doc_id, 0 AS blk, {UNIX} AS text FROM documents), {cut('p', 'd', 4096, 512)},
held AS (SELECT p.doc_id, ord AS blk, trim(piece, {BLANK}) AS text, greatest(strpos(d.text, left(trim(piece, {BLANK}), 60)) - 1, 0)::INT AS start FROM p JOIN d USING (doc_id)), {cut('c', 'held', 384, 100)}
SELECT doc_id, 'p' || blk AS pid, '' AS cid, text, '' AS breadcrumb, start, (start + length(text))::INT AS "end" FROM held UNION ALL
SELECT c.doc_id, 'p' || blk, 'p' || blk || '_c' || ord, piece, '', start, (start + length(piece))::INT FROM c JOIN held USING (doc_id, blk)""")
def _(spark, sf):
    return C.chunk_parent_child(table(spark, sf, "documents"))


#: documents with headings of two levels (even doc_ids) or numbered lines (odd ones), a preamble before them.
MARKED = "CASE WHEN doc_id % 2 = 0 AND i % 7 = 2 THEN '## ' WHEN doc_id % 2 = 0 AND i % 7 = 4 THEN '### ' WHEN doc_id % 2 = 1 AND i % 4 = 2 THEN i || '.1 ' ELSE '' END || x"


@query("chunk_structured", rf"""WITH RECURSIVE t AS (SELECT doc_id, string_split(array_to_string(list_transform(string_split({UNIX}, '. '), lambda x, i: {MARKED}), chr(10)), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
h AS (SELECT doc_id, i, line, CASE WHEN regexp_matches(regexp_extract(line, '{HEAD}', 2), '[A-Za-z一-鿿]') THEN length(regexp_extract(line, '{HEAD}', 1)) ELSE 0 END AS depth, regexp_extract(line, '{HEAD}', 2) AS title FROM l),
n AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (depth = 2) AS h2, count(*) FILTER (depth = 3) AS h3, count(*) FILTER (depth = 0 AND regexp_matches(line, '{MARKER}')) AS marks FROM h GROUP BY doc_id),
v AS (SELECT *, CASE WHEN h2 >= 3 THEN 2 WHEN h3 >= 1 THEN 3 ELSE 2 END AS lvl FROM n),
k AS (SELECT doc_id, lvl, CASE WHEN h2 + h3 >= 3 AND (h2 + h3) / lines > 0.005 AND (CASE lvl WHEN 2 THEN h2 ELSE h3 END) >= 2 THEN 'h' WHEN marks >= 5 THEN 'm' ELSE 'r' END AS tier FROM v),
b AS (SELECT h.*, tier, lvl, CASE tier WHEN 'h' THEN depth = lvl WHEN 'm' THEN regexp_matches(line, '{MARKER}') ELSE false END AS first, last_value(CASE WHEN depth > 0 AND depth < lvl THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS above FROM h JOIN k USING (doc_id)),
g AS (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS blk FROM b),
s AS (SELECT doc_id, blk, any_value(tier) AS tier, any_value(lvl) AS lvl, max(CASE WHEN first AND tier = 'h' THEN concat_ws(' › ', above, title) ELSE '' END) AS crumb, list(line ORDER BY i) FILTER (NOT (first AND tier = 'h')) AS ls FROM g GROUP BY doc_id, blk),
src AS (SELECT *, CASE tier WHEN 'r' THEN array_to_string(ls, chr(10)) ELSE trim(array_to_string(ls, chr(10)), {BLANK}) END AS text FROM s),
long AS (SELECT * FROM src WHERE tier = 'r' OR length(text) + CASE WHEN crumb = '' THEN 0 ELSE length(crumb) + 2 END > 500), {cut('c', 'long', 500, 100)},
pieces AS (SELECT doc_id, blk, ord, piece, crumb, tier, lvl, CASE WHEN strpos(text, piece) > 1 THEN list_filter(string_split(left(array_to_string(ls[1:40], chr(10)), strpos(text, piece) + 399), chr(10)),
 lambda x: regexp_matches(regexp_extract(x, '{HEAD}', 2), '[A-Za-z一-鿿]') AND length(regexp_extract(x, '{HEAD}', 1)) >= lvl)[-1] END AS under FROM c JOIN long USING (doc_id, blk)),
everything AS (SELECT doc_id, blk, ord, piece, CASE WHEN crumb = '' THEN '' ELSE concat_ws(' › ', crumb, regexp_extract(under, '{HEAD}', 2)) END AS crumb FROM pieces UNION ALL
 SELECT doc_id, blk, 0, text, crumb FROM src WHERE text <> '' AND tier <> 'r' AND length(text) + CASE WHEN crumb = '' THEN 0 ELSE length(crumb) + 2 END <= 500)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY blk, ord) - 1)::INT AS chunk_ord, piece AS text, crumb AS breadcrumb FROM everything""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    n = lambda i: i + 1
    mark = lambda i: F.when((F.col("doc_id") % 2 == 0) & (n(i) % 7 == 2), "## ").when((F.col("doc_id") % 2 == 0) & (n(i) % 7 == 4), "### ").when((F.col("doc_id") % 2 == 1) & (n(i) % 4 == 2), F.concat(n(i).cast("string"), F.lit(".1 "))).otherwise("")
    text = F.array_join(F.transform(F.split("text", r"\. ", -1), lambda x, i: F.concat(mark(i), x)), "\n")
    return C.chunk_documents(d.select("doc_id", text.alias("text")))
