"""Queries of wiki pages, decks, edits, logs and listings that are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.inputs import SITES, input_type, site_name
from loam.operators import corpus as C
from loam.operators import graph as G
from loam.operators import package as P
from loam.operators import retrieval as R
from loam.operators import scan
from loam.operators import trace as L
from loam.plans.corpus_queries import EDGES, POSTINGS, postings
from loam.plans.retrieval_queries import table
from loam.sources import files as S

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(fn):
        Q[name], SQL[name] = fn, sql
        return fn

    return add


# Wiki pages: each document is one, links to two others and to itself, and has two sources that it shares with its neighbours.
WIKI = r"""wk AS (SELECT 't' || doc_id AS topic, text || ' [[t' || (doc_id // 2) || ']] [[ t' || (doc_id + 3) || '#x|next]] [[t' || doc_id || ']] [[nowhere]]' AS body, ['s' || (doc_id // 16), 'r' || ((doc_id + 8) // 16)] AS sources FROM documents),
ln AS (SELECT DISTINCT topic AS src, trim(unnest(regexp_extract_all(body, '\[\[([^\]|#]+)', 1))) AS dst FROM wk),
le AS (SELECT src, dst FROM ln WHERE src <> dst AND dst IN (SELECT topic FROM wk)),
ci AS (SELECT DISTINCT topic, unnest(sources) AS source FROM wk),
co AS (SELECT a.topic AS a, b.topic AS b, a.source FROM ci a JOIN ci b ON a.source = b.source AND a.topic < b.topic),
ev AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, 0 AS o, 'link' AS via FROM le UNION ALL SELECT a, b, 1, 'co-cite:' || source FROM co),
we AS (SELECT a, b, first(via ORDER BY o, via) AS kind, list(via ORDER BY o, via) AS via FROM ev GROUP BY a, b)"""


def wiki(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    number = lambda x: x.cast("long").cast("string")
    body = F.concat("text", F.lit(" [[t"), number(F.floor(n / 2)), F.lit("]] [[ t"), number(n + 3), F.lit("#x|next]] [[t"), number(n), F.lit("]] [[nowhere]]"))
    return d.select(F.concat(F.lit("t"), number(n)).alias("topic"), T.wiki_links(body).alias("links"), F.array(F.concat(F.lit("s"), number(F.floor(n / 16))), F.concat(F.lit("r"), number(F.floor((n + 8) / 16)))).alias("sources"))


@query("wiki_links_of_documents", f"WITH {WIKI} SELECT src, dst FROM le")
def _(spark, sf):
    return G.wiki_link_edges(wiki(spark, sf))


@query("wiki_cocitations", f"WITH {WIKI} SELECT a, b, source FROM co")
def _(spark, sf):
    return G.wiki_cocite_edges(wiki(spark, sf))


@query("wiki_graph", f"WITH {WIKI} SELECT a, b, kind, array_to_string(via, ',') AS via FROM we")
def _(spark, sf):
    return G.wiki_edges(wiki(spark, sf)).select("a", "b", "kind", F.array_join("via", ",").alias("via"))


@query("wiki_topic_degrees", f"WITH {WIKI} SELECT topic, (SELECT count(*) FROM we WHERE we.b = wk.topic) AS in_deg, (SELECT count(*) FROM le WHERE le.src = wk.topic) AS out_deg FROM wk")
def _(spark, sf):
    w = wiki(spark, sf)
    return G.wiki_degrees(w, G.wiki_edges(w))


@query("wiki_drawn", f"WITH {WIKI}, t AS (SELECT * FROM we ORDER BY len(via) DESC, a, b LIMIT 60) SELECT 'graph LR' || chr(10) || string_agg('  ' || a || ' --- ' || b, chr(10) ORDER BY len(via) DESC, a, b) AS mermaid FROM t")
def _(spark, sf):
    return G.wiki_mermaid(G.wiki_edges(wiki(spark, sf)))


# Entity graph of documents -------------------------------------------------------------------------------------------


@query("entity_top", f"WITH {POSTINGS} SELECT term, count(*) AS df FROM po GROUP BY term HAVING count(*) >= 2 ORDER BY count(*) DESC, term LIMIT 20")
def _(spark, sf):
    return G.top_nodes(G.nodes(postings(spark, sf)), 20)


@query("entity_neighbours", f"""WITH {EDGES}, t AS (SELECT term FROM po GROUP BY term ORDER BY count(*) DESC, term LIMIT 1)
SELECT CASE WHEN a = t.term THEN b ELSE a END AS term, w FROM ed, t WHERE a = t.term OR b = t.term ORDER BY w DESC, 1 LIMIT 10""")
def _(spark, sf):
    p = postings(spark, sf)
    top = G.top_nodes(G.nodes(p), 1).first()
    return G.neighbours(G.edges(p, 3), top.term if top else "", 10)


# Edits: a third of the documents get another spelling, every second of these goes back. -----------------------
EDITS = """e0 AS (SELECT lang AS kb, doc_id AS chunk_ord, text, length(text) % 3 = 0 AND contains(text, 'e') AS hit, doc_id % 2 = 0 AS back FROM documents)"""


def edited(spark, sf):
    revs = F.array().cast("array<struct<v:int,text:string,at:string,note:string>>").alias("revs")
    d = table(spark, sf, "documents").select(F.col("lang").alias("kb"), F.col("doc_id").alias("chunk_ord"), "text", revs)
    changes = d.filter(F.char_length("text") % 3 == 0).select("kb", "chunk_ord", F.replace("text", F.lit("e"), F.lit("E")).alias("new_text"))
    new = C.edit(d, changes, "t1")
    return C.rollback(new, new.filter("chunk_ord % 2 = 0 AND size(revs) > 0").select("kb", "chunk_ord", F.lit(1).alias("v")), "t2")


@query("edits_of_documents", f"""WITH {EDITS} SELECT chunk_ord, md5(CASE WHEN hit AND NOT back THEN replace(text, 'e', 'E') ELSE text END) AS digest, CASE WHEN hit THEN 1 + back::INT ELSE 0 END AS n,
CASE WHEN hit THEN md5(text) END AS first, CASE WHEN hit AND back THEN 'rollback' WHEN hit THEN 'edit' END AS note FROM e0""")
def _(spark, sf):
    r = lambda i: F.get("revs", i)
    return edited(spark, sf).select("chunk_ord", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("revs").alias("n"), F.md5(r(F.lit(0)).text.cast("binary")).alias("first"), r(F.size("revs") - 1).note.alias("note"))


@query("edit_counts", f"WITH {EDITS} SELECT count(*) AS chunks, count(*) FILTER (hit) AS edited, coalesce(sum(CASE WHEN hit THEN 1 + back::INT END), 0)::BIGINT AS revs FROM e0")
def _(spark, sf):
    return C.editor_stats(edited(spark, sf))


@query("revisions_of_events", "SELECT event_id AS at, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS v FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("kb"), F.col("user_id").alias("chunk_ord"), F.col("event_id").alias("at"))
    return C.rev_numbering(e).select("at", "v")


# Decks: events are slides of a few versions. -------------------------------------------------------------------------------
DECK = """dk AS (SELECT 'v' || (user_id % 5) AS version, event_id AS idx, CASE WHEN event_type IN ('click', 'view') THEN 'a.mp3' ELSE '' END AS audio, CASE WHEN event_id % 3 = 0 THEN 'b.mp3' END AS audio_en,
CASE event_id % 4 WHEN 0 THEN 'amy' WHEN 1 THEN 'bob' WHEN 2 THEN '' END AS audio_person, CASE WHEN event_id % 7 = 0 THEN 'cid' END AS audio_person_en, event_id % 2 = 0 AS video FROM events)"""


def deck(spark, sf):
    i = F.col("event_id")
    person = F.when(i % 4 == 0, "amy").when(i % 4 == 1, "bob").when(i % 4 == 2, "")
    videos = F.when(i % 2 == 0, F.array(F.lit("amy_selfie"), F.lit("bob"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("v"), (F.col("user_id") % 5).cast("string")).alias("version"), i.alias("idx"), F.when(F.col("event_type").isin("click", "view"), "a.mp3").otherwise("").alias("audio"),
        F.when(i % 3 == 0, "b.mp3").alias("audio_en"), person.alias("audio_person"), F.when(i % 7 == 0, "cid").alias("audio_person_en"), videos.alias("video_keys"))


@query("deck_voices", f"""WITH {DECK}, v AS (SELECT coalesce(nullif(audio_person, ''), 'default') AS person, audio <> '' AS zh, false AS en FROM dk
UNION ALL SELECT coalesce(nullif(audio_person_en, ''), nullif(audio_person, ''), 'default'), false, coalesce(audio_en, '') <> '' FROM dk) SELECT person, bool_or(zh) AS zh, bool_or(en) AS en FROM v GROUP BY 1 HAVING bool_or(zh) OR bool_or(en)""")
def _(spark, sf):
    return P.voice_matrix(deck(spark, sf))


@query("deck_languages", f"WITH {DECK}, h AS (SELECT bool_or(audio <> '') AS zh, bool_or(coalesce(audio_en, '') <> '') AS en FROM dk) SELECT CASE WHEN zh AND NOT en THEN 'zh' WHEN en AND NOT zh THEN 'en' ELSE 'zh,en' END AS langs FROM h")
def _(spark, sf):
    return P.languages(deck(spark, sf)).select(F.array_join("langs", ",").alias("langs"))


@query("deck_segments", f"""WITH {DECK}, g AS (SELECT version, p.person, l.lang, CASE WHEN l.lang = 'zh' THEN audio ELSE coalesce(audio_en, '') END AS a,
CASE WHEN l.lang = 'zh' THEN nullif(audio_person, '') ELSE coalesce(audio_person_en, nullif(audio_person, '')) END AS owner, video FROM dk, (VALUES ('amy'), ('cid')) p(person), (VALUES ('zh'), ('en')) l(lang)),
s AS (SELECT version, person, lang, count(*) FILTER (a = '') AS missing, min(owner) FILTER (a <> '' AND owner <> person) AS other, bool_or(video AND person = 'amy') AS mine, bool_or(video) AS videos FROM g GROUP BY 1, 2, 3),
t AS (SELECT version, person, lang, missing, concat_ws('；', CASE WHEN missing > 0 THEN '缺音频' || missing || '页' END, CASE WHEN other IS NOT NULL THEN '声音属于' || other END, CASE WHEN videos AND NOT mine THEN '无视频' END) AS reason FROM s)
SELECT version, person, lang, missing, reason = '' AS ready, reason FROM t""")
def _(spark, sf):
    people = table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, "amy").otherwise(F.when(F.col("event_id") % 3 == 0, "default").otherwise("cid")).alias("person")).distinct()
    return P.segments(deck(spark, sf), people).drop("pages")


@query("deck_overlay", """WITH b AS (SELECT event_id AS idx, event_type AS n, 'a' || user_id AS a FROM events), v AS (SELECT idx, CASE WHEN idx % 6 = 0 THEN 'new ' || n END AS n, CASE WHEN idx % 6 = 3 THEN 'b' END AS a FROM b WHERE idx % 3 = 0)
SELECT b.idx, coalesce(v.n, b.n) AS narration, coalesce(v.a, b.a) AS audio FROM b LEFT JOIN v USING (idx)""")
def _(spark, sf):
    base = table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("narration"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("audio"))
    changed = base.filter("idx % 3 = 0").select("idx", F.when(F.col("idx") % 6 == 0, F.concat(F.lit("new "), "narration")).alias("narration"), F.when(F.col("idx") % 6 == 3, "b").alias("audio"))
    return P.version_overlay(base, changed)


SLIDES = "sl AS (SELECT doc_id AS idx, source AS title, text, CASE WHEN doc_id % 2 = 0 THEN lang END AS notes FROM documents)"


def slides(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("title"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("notes"))


BARE = "trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288)) = ''"


@query("slide_texts", f"WITH {SLIDES} SELECT idx, md5(concat_ws(chr(10) || chr(10), '【PPT第' || idx || '页 ' || coalesce(title, '') || '】', CASE WHEN {BARE} THEN NULL ELSE text END, notes)) AS digest FROM sl")
def _(spark, sf):
    return P.slide_text(slides(spark, sf)).select("idx", F.md5(F.col("flat").cast("binary")).alias("digest"))


@query("slide_chunk_texts", f"WITH {SLIDES} SELECT idx, md5(concat_ws(chr(10), '【第' || idx || '页 ' || coalesce(title, '') || '】', CASE WHEN {BARE} THEN NULL ELSE text END, '（备注）' || notes)) AS digest FROM sl")
def _(spark, sf):
    return P.slide_chunk(slides(spark, sf)).select("idx", F.md5(F.col("chunk").cast("binary")).alias("digest"))


# Files: events are media files of a listing, purchases refer to them. --------------------------------------------------------
MEDIA = "fl AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'demo_av_v' || (user_id % 5) || '_amy_selfie_' || event_id || '.mp4' ELSE 'x' || event_id || '.mp3' END AS file FROM events)"


def media(spark, sf):
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    name = F.when(i % 2 == 0, F.concat(F.lit("demo_av_v"), (F.col("user_id") % 5).cast("string"), F.lit("_amy_selfie_"), n, F.lit(".mp4"))).otherwise(F.concat(F.lit("x"), n, F.lit(".mp3")))
    return table(spark, sf, "events").select(name.alias("file"), "event_type")


@query("media_parts", f"WITH {MEDIA} SELECT file, regexp_extract(file, 'av_([^_]+)_', 1) AS version, 'amy_selfie' AS key, event_id::INT AS idx FROM fl WHERE file LIKE '%.mp4'")
def _(spark, sf):
    return P.video_parts(media(spark, sf).select("file"))


@query("media_referred", f"""WITH {MEDIA}, a AS (SELECT file FROM fl UNION ALL SELECT replace(file, '.mp4', '_dur.json') FROM fl WHERE file LIKE '%.mp4'), r AS (SELECT file FROM fl JOIN events USING (event_id) WHERE event_type = 'purchase')
SELECT file FROM r UNION SELECT file FROM a WHERE file IN (SELECT replace(file, '.mp4', '_dur.json') FROM r WHERE file LIKE '%.mp4')""")
def _(spark, sf):
    m = media(spark, sf)
    notes = m.filter("file LIKE '%.mp4'").select(F.replace("file", F.lit(".mp4"), F.lit("_dur.json")).alias("file"))
    refs = m.filter("event_type = 'purchase'").select(F.concat(F.lit("http://h/video/"), "file", F.lit("?v=1#t")).alias("url"))
    return P.media_semi_join(m.select("file").unionByName(notes), refs)


PATHS = """pa AS (SELECT page_id, '/kb/' || CASE page_id % 5 WHEN 0 THEN '.git/' WHEN 1 THEN 'node_modules/' ELSE '' END || CASE page_id % 7 WHEN 0 THEN '~$' WHEN 1 THEN '.' ELSE '' END || 'p' || page_id ||
CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.DOCX' ELSE '.exe' END AS path, length(html) AS length FROM pages)"""


def paths(spark, sf):
    i = F.col("page_id")
    kind = F.when(i % 3 == 0, ".md").when(i % 3 == 1, ".DOCX").otherwise(".exe")
    folder, mark = F.when(i % 5 == 0, ".git/").when(i % 5 == 1, "node_modules/").otherwise(""), F.when(i % 7 == 0, "~$").when(i % 7 == 1, ".").otherwise("")
    return table(spark, sf, "pages").select(F.concat(F.lit("/kb/"), folder, mark, F.lit("p"), i.cast("string"), kind).alias("path"), F.char_length("html").cast("long").alias("length"))


@query("listing_filtered", f"WITH {PATHS} SELECT path FROM pa WHERE page_id % 5 > 1 AND page_id % 7 > 1 AND page_id % 3 < 2")
def _(spark, sf):
    return S.filtered(paths(spark, sf).select("path"), (".md", ".docx"))


@query("listing_status", f"WITH {PATHS} SELECT stage, count(*) FILTER (regexp_matches(path, p) AND length > 0) AS files, count(*) FILTER (regexp_matches(path, p) AND length > 0) > 0 AS done FROM pa, (VALUES ('text', '\\.md$'), ('office', '\\.DOCX$'), ('video', '\\.mp4$')) s(stage, p) GROUP BY stage")
def _(spark, sf):
    return P.pipeline_status(paths(spark, sf), [("text", r"\.md$"), ("office", r"\.DOCX$"), ("video", r"\.mp4$")])


#: Addresses of pages on the hosts of the table of sites, in turn.
HOSTS = [h.lstrip(".") for h, _, _ in SITES] + ["example.org", "douyin.com", "youtu.be"]
URLS = "ur AS (SELECT page_id, ['" + "', '".join(HOSTS) + f"'][page_id % {len(HOSTS)} + 1] AS host FROM pages)"


def urls(spark, sf):
    host = F.get(F.array(*[F.lit(h) for h in HOSTS]), (F.col("page_id") % len(HOSTS)).cast("int"))
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://u@www."), host, F.lit("/a?b=mp.weixin.qq.com"), F.col("page_id").cast("string")).alias("url"))


@query("page_sites", f"WITH {URLS} SELECT page_id, CASE " + " ".join(f"WHEN host = '{h.lstrip('.')}' THEN '{n}'" for h, n, _ in SITES) + " ELSE '网页' END AS site FROM ur")
def _(spark, sf):
    return urls(spark, sf).select("page_id", site_name("url").alias("site"))


@query("page_kinds", f"WITH {URLS} SELECT page_id, CASE WHEN host = 'douyin.com' THEN 'paste' WHEN host = 'youtu.be' THEN 'removed' " + " ".join(f"WHEN host = '{h}' THEN '{k}'" for h, _, k in SITES if k) + " ELSE 'url' END AS kind FROM ur")
def _(spark, sf):
    return urls(spark, sf).select("page_id", input_type("url", T.EXTENSIONS).alias("kind"))


# Logs -----------------------------------------------------------------------------------------------------------------


@query("history_of_users", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def _(spark, sf):
    return L.compact_history(table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").alias("ts")), "user_id", 5).select("user_id", "event_id")


@query("history_parsed", """WITH h AS (SELECT conv_id, list(role || '' ORDER BY turn, role, text) AS q, list(turn::VARCHAR ORDER BY turn, role, text) AS a FROM conversations GROUP BY 1),
l AS (SELECT conv_id, unnest(q[greatest(1, len(q) - 2):]) AS q, unnest(a[greatest(1, len(q) - 2):]) AS a, unnest(range(least(3, len(q))))::INT AS pos FROM h) SELECT conv_id, pos, q, a FROM l""")
def _(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit(" ｜ "), x.turn.cast("string"))), " && ")
    return t.select("conv_id", F.posexplode(L.history_parse(said)).alias("pos", "x")).select("conv_id", "pos", "x.q", "x.a")


@query("agent_fields", "SELECT conv_id AS id, coalesce(string_agg(DISTINCT 'a' || (turn % 3), ',' ORDER BY 'a' || (turn % 3)) FILTER (role = 'assistant'), '') AS actions, count(*) FILTER (role = 'assistant')::INT AS tool_steps FROM conversations GROUP BY 1")
def _(spark, sf):
    step = F.struct(F.when(F.col("role") == "assistant", "tool").otherwise("think").alias("type"), F.concat(F.lit("a"), (F.col("turn") % 3).cast("string")).alias("action"))
    runs = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(step).alias("steps"))
    return L.agent_stats(runs).select("id", F.array_join("actions", ",").alias("actions"), "tool_steps")


@query("question_log", """WITH l AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' ORDER BY 1 DESC LIMIT 500) SELECT id, '**' || text || '**' || chr(10) || chr(10) AS text FROM l WHERE id >= (SELECT min(conv_id) * 1000 + 5 FROM conversations)""")
def _(spark, sf):
    asked = table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))
    log = L.qa_add(asked.filter("id % 2 = 0"), asked.filter("id % 2 = 1"), 500)
    least = table(spark, sf, "conversations").agg(F.min("conv_id")).first()[0] or 0
    return L.qa_export(L.qa_clear(log, least * 1000 + 5))


@query("context_of_sources", "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) WHERE used <= 5000")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.char_length("text").alias("n"))
    return scan.take_while(d, ["source"], ["doc_id"], F.col("n"), 5000).select("doc_id")


@query("slides_of_hits", """WITH h AS (SELECT conv_id AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank, length(text) % 10 AS score, CASE WHEN turn % 2 = 0 THEN turn::INT + 1 END AS page, '第 ' || (turn + 100) || ' 页' AS label FROM conversations),
p AS (SELECT q, rank, score, coalesce(page, regexp_extract(label, '(\\d+)', 1)::INT) AS page FROM h WHERE rank <= 8) SELECT q, last(page ORDER BY score, rank) AS page FROM p GROUP BY q""")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    h = table(spark, sf, "conversations").select(F.col("conv_id").alias("q"), F.row_number().over(w).alias("rank"), (F.char_length("text") % 10).alias("score"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("int") + 1).alias("page"), F.concat(F.lit("第 "), (F.col("turn") + 100).cast("string"), F.lit(" 页")).alias("label"))
    return R.related_slide(h, "q")
