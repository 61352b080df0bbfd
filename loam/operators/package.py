"""Slide decks: narration, versions, playback timelines, voices and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import scan

GAP, SILENT, TOLERANCE = 0.4, 1.0, 0.05


def slide_text(slides: DataFrame) -> DataFrame:
    """Slides with flat: page header, text, notes, by empty lines."""
    head = F.concat(F.lit("【PPT第"), F.col("idx").cast("string"), F.lit("页 "), F.coalesce("title", F.lit("")), F.lit("】"))
    return slides.withColumn("flat", F.concat_ws("\n\n", head, T.blank_to_null("text"), T.blank_to_null("notes")))


def slide_chunk(slides: DataFrame) -> DataFrame:
    head = F.concat(F.lit("【第"), F.col("idx").cast("string"), F.lit("页 "), F.coalesce("title", F.lit("")), F.lit("】"))
    note = F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.concat(F.lit("（备注）"), F.col("notes")))
    return slides.withColumn("chunk", F.concat_ws("\n", head, T.blank_to_null("text"), note))


def narration_plan(slides: DataFrame, narration: DataFrame) -> DataFrame:
    """idx, narration: that of the slide's number, else that of its position, else its notes."""
    pos = F.row_number().over(Window.partitionBy("project").orderBy("idx"))
    s = slides.withColumn("pos", pos)
    by_idx = narration.select("project", F.col("n").alias("idx"), F.col("narration").alias("own"))
    by_pos = narration.select("project", F.col("n").alias("pos"), F.col("narration").alias("at_pos"))
    out = s.join(by_idx, ["project", "idx"], "left").join(by_pos, ["project", "pos"], "left")
    return out.select("project", "idx", F.coalesce("own", "at_pos", T.blank_to_null("notes"), F.lit("")).alias("narration"))


def version_overlay(base: DataFrame, version: DataFrame) -> DataFrame:
    """Base slides (idx, narration, audio) with what the version sets; a version of at least as many slides replaces all."""
    size = base.agg(F.count("*").alias("nb")).crossJoin(version.agg(F.count("*").alias("nv")))
    v = version.select("idx", F.col("narration").alias("vn"), F.col("audio").alias("va"))
    laid = base.join(v, "idx", "full").crossJoin(F.broadcast(size))
    whole = F.col("nv") >= F.col("nb")
    out = laid.withColumn("n", F.when(whole, F.col("vn")).otherwise(F.coalesce("vn", "narration"))).withColumn("a", F.when(whole, F.col("va")).otherwise(F.coalesce("va", "audio")))
    kept = F.when(whole, F.col("vn").isNotNull() | F.col("va").isNotNull()).otherwise(F.col("narration").isNotNull() | F.col("audio").isNotNull())
    return out.filter(kept).select("idx", F.col("n").alias("narration"), F.col("a").alias("audio"))


def timeline(slides: DataFrame, by: list[str], order: str, duration: str, split: bool = False) -> DataFrame:
    """slides with start_at: what was played before, a gap after each; a slide without audio takes a second. With split a key
    may hold any number of slides: it is scanned in ranges. by may be empty: one timeline, in ranges."""
    d = F.coalesce(F.col(duration), F.lit(SILENT)).cast("double") + GAP
    if split or not by:
        return scan.prefix(slides, by, [order], befores={"start_at": d}).withColumn("start_at", F.col("start_at").cast("double"))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return slides.withColumn("start_at", F.coalesce(F.sum(d).over(w), F.lit(0.0)))


def asof(times: DataFrame, starts: DataFrame, by: list[str], split: bool = False) -> DataFrame:
    """times (by, t) with idx: the last start at or before t plus the tolerance. One sort by key, no range join; with split a
    key is scanned in ranges."""
    if split or not by:
        asked = times.select(*by, "t", (F.col("t") + TOLERANCE).alias("at"))
        return scan.asof(asked, starts.select(*by, F.col("start_at").alias("at"), "idx"), by, "at", "idx").select(*by, "t", "idx")
    marks = starts.select(*by, F.col("start_at").alias("at"), F.lit(0).alias("kind"), "idx", F.lit(None).cast("double").alias("t"))
    asked = times.select(*by, (F.col("t") + TOLERANCE).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["idx"].dataType).alias("idx"), "t")
    w = Window.partitionBy(*by).orderBy("at", "kind", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn("idx", F.last("idx", True).over(w)).filter(F.col("kind") == 1).select(*by, "t", "idx")


def media_semi_join(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files that something refers to, and the duration notes of included videos."""
    named = refs.select(T.media_basename("url").alias("file")).distinct()
    held = files.join(named, "file", "left_semi")
    stems = held.filter(F.lower("file").endswith(".mp4")).select(F.concat(F.regexp_replace("file", r"\.[^.]+$", ""), F.lit("_dur.json")).alias("file"))
    return held.unionByName(files.join(stems.distinct(), "file", "left_semi")).distinct()


def video_parts(files: DataFrame) -> DataFrame:
    """version, key, idx out of names like demo_av_<version>_<key>_<idx>.mp4, to be joined by equality."""
    p = r"^demo_av_([^_]+)_(.+)_(\d+)\.mp4$"
    return files.filter(F.rlike("file", F.lit(p))).select("file", *[F.regexp_extract("file", p, i + 1).alias(n) for i, n in enumerate(("version", "key"))], F.regexp_extract("file", p, 3).cast("int").alias("idx"))


def voice_matrix(slides: DataFrame) -> DataFrame:
    """person, zh, en: whether any slide has that person's audio; without a person the default's."""
    zh = slides.select(F.coalesce(T.blank_to_null("audio_person"), F.lit("default")).alias("person"), (F.coalesce("audio", F.lit("")) != "").alias("zh"), F.lit(False).alias("en"))
    en = slides.select(F.coalesce(T.blank_to_null("audio_person_en"), T.blank_to_null("audio_person"), F.lit("default")).alias("person"), F.lit(False).alias("zh"), (F.coalesce("audio_en", F.lit("")) != "").alias("en"))
    return zh.unionByName(en).groupBy("person").agg(F.bool_or("zh").alias("zh"), F.bool_or("en").alias("en")).filter("zh or en")


def languages(slides: DataFrame) -> DataFrame:
    """One row: langs, zh before en; both where no slide has audio."""
    has = slides.agg(F.coalesce(F.bool_or(F.coalesce("audio", F.lit("")) != ""), F.lit(False)).alias("zh"), F.coalesce(F.bool_or(F.coalesce("audio_en", F.lit("")) != ""), F.lit(False)).alias("en"))
    arr = F.filter(F.array(F.when(F.col("zh"), "zh"), F.when(F.col("en"), "en")), lambda x: x.isNotNull())
    return has.select(F.when(F.size(arr) == 0, F.array(F.lit("zh"), F.lit("en"))).otherwise(arr).alias("langs"))


def segments(slides: DataFrame, persons: DataFrame) -> DataFrame:
    """version, person, lang, pages, missing, ready, reason: the grid of persons (but `default`), languages and versions.

    A voice is held against a person only where the version says whose voice it is. A video key may be a person's id or
    start with it and an underscore."""
    langs = F.explode(F.array(F.lit("zh"), F.lit("en"))).alias("lang")
    grid = slides.select("version", "idx", "audio", "audio_en", "audio_person", "audio_person_en", "video_keys").crossJoin(F.broadcast(persons.filter("person <> 'default'").select("person"))).select("*", langs)
    audio = F.coalesce(F.when(F.col("lang") == "zh", F.col("audio")).otherwise(F.col("audio_en")), F.lit(""))
    owner = F.when(F.col("lang") == "zh", T.blank_to_null("audio_person")).otherwise(F.coalesce(T.blank_to_null("audio_person_en"), T.blank_to_null("audio_person")))
    video = F.exists(F.coalesce("video_keys", F.array().cast("array<string>")), lambda k: F.split(k, "_")[0] == F.col("person"))
    marked = grid.withColumn("_none", audio == "").withColumn("_other", F.when((audio != "") & owner.isNotNull() & (owner != F.col("person")), owner)).withColumn("_video", video).withColumn("_any_video", F.size(F.coalesce("video_keys", F.array().cast("array<string>"))) > 0)
    agg = marked.groupBy("version", "person", "lang").agg(F.count("*").alias("pages"), F.count_if("_none").alias("missing"), F.min("_other").alias("other"), F.bool_or("_video").alias("video"), F.bool_or("_any_video").alias("videos"))
    reason = F.concat_ws("；", F.when(F.col("missing") > 0, F.concat(F.lit("缺音频"), F.col("missing").cast("string"), F.lit("页"))), F.when(F.col("other").isNotNull(), F.concat(F.lit("声音属于"), F.col("other"))), F.when(F.col("videos") & ~F.col("video"), F.lit("无视频")))
    return agg.select("version", "person", "lang", "pages", "missing", (reason == "").alias("ready"), reason.alias("reason"))


def pipeline_status(files: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """stage, files, done over a listing (path, length): non-empty files whose path matches the stage's pattern."""
    one = files.agg(*[F.count_if(F.rlike("path", F.lit(p)) & (F.col("length") > 0)).alias(n) for n, p in stages])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("files"), (F.col(n) > 0).alias("done")) for n, _ in stages])))


def resolve_person(wanted: DataFrame, persons: DataFrame, files: DataFrame) -> DataFrame:
    """id, person, avatar, file of each wanted (id, person, avatar; the latter two may be null or unknown).

    persons: person, ord, is_default, active (the default's chosen avatar), avatars array<struct<avatar,file>>. A person
    not known is the default one, or the first; an avatar not known is the default person's chosen one, or the first. file
    is null where files (file) lack it, or there is nobody. persons is one installation's list."""
    p = persons.select("person", "ord", F.coalesce("is_default", F.lit(False)).alias("is_default"), "active", "avatars")
    first = p.agg(F.min_by("person", F.struct(~F.col("is_default"), "ord")).alias("chosen"), F.min_by("person", "ord").alias("first"), F.bool_or("is_default").alias("any"))
    asked = wanted.select("id", F.col("person").alias("named"), F.col("avatar").alias("face")).crossJoin(F.broadcast(first))
    asked = asked.join(p.select(F.col("person").alias("known")), F.col("named") == F.col("known"), "left")
    # Nobody named: the default. Somebody unknown: the first.
    who = F.coalesce("known", F.when(F.col("named").isNull() & F.col("any"), F.col("chosen")).otherwise(F.col("first")))
    held = asked.select("id", who.alias("person"), "face").join(p, "person", "left")
    face = F.coalesce(F.when(F.col("face") != "", F.col("face")), F.when(F.col("is_default"), F.col("active")))
    found = F.coalesce(F.get(F.filter("avatars", lambda a: a.avatar == face), F.lit(0)), F.get("avatars", F.lit(0)))
    out = held.select("id", "person", found.alias("a")).select("id", "person", F.col("a.avatar").alias("avatar"), F.col("a.file").alias("f"))
    return out.join(files.select(F.col("file").alias("f"), F.lit(True).alias("there")).distinct(), "f", "left").select("id", "person", "avatar", F.when(F.col("there"), F.col("f")).alias("file"))


def version_create(versions: DataFrame, project: str, version: str, title: str = "") -> DataFrame:
    """versions (project, version, ord, title, current) with one more, which becomes current; one that is there already is
    only made current."""
    mine = F.col("project") == project
    place = versions.filter(mine).agg(F.coalesce(F.max("ord") + 1, F.lit(1)).alias("ord"), F.count_if(F.col("version") == version).alias("held"))
    fresh = place.filter("held = 0").select(F.lit(project).alias("project"), F.lit(version).alias("version"), F.col("ord").cast(versions.schema["ord"].dataType).alias("ord"), F.lit(title or version).alias("title"), F.lit(False).alias("current"))
    return version_switch(versions.unionByName(fresh), project, version)


def version_switch(versions: DataFrame, project: str, version: str) -> DataFrame:
    """versions with that one current in its project; an unknown one changes nothing."""
    mine = F.col("project") == project
    known = versions.agg(F.coalesce(F.bool_or(mine & (F.col("version") == version)), F.lit(False)).alias("known"))
    out = versions.crossJoin(F.broadcast(known))
    return out.withColumn("current", F.when(mine & F.col("known"), F.col("version") == version).otherwise(F.col("current"))).select(*versions.columns)


def version_rename(versions: DataFrame, project: str, version: str, title: str) -> DataFrame:
    """versions with that one's title changed; a blank title changes nothing."""
    hit = (F.col("project") == project) & (F.col("version") == version) & F.lit(bool(title.strip()))
    return versions.withColumn("title", F.when(hit, F.lit(title.strip())).otherwise(F.col("title")))


def version_delete(versions: DataFrame, project: str, version: str) -> DataFrame:
    """versions without that one, unless it is its project's last; if it was current, the first that is left becomes so."""
    mine = F.col("project") == project
    others = versions.filter(mine & (F.col("version") != version)).agg(F.count("*").alias("others"), F.min_by("version", "ord").alias("heir"))
    was = versions.agg(F.coalesce(F.bool_or(mine & (F.col("version") == version) & F.col("current")), F.lit(False)).alias("was"))
    out = versions.crossJoin(F.broadcast(others)).crossJoin(F.broadcast(was)).filter(~(mine & (F.col("version") == version) & (F.col("others") > 0)))
    heir = mine & F.col("was") & (F.col("others") > 0)
    return out.withColumn("current", F.when(heir, F.col("version") == F.col("heir")).otherwise(F.col("current"))).select(*versions.columns)


def outline(sections: DataFrame, pages: int, topic: str = "") -> DataFrame:
    """ord, title of a deck of so many pages: the sections' titles, as many as leave room for the page that sums up; a topic
    takes the first page. sections: ord (from 1), raw."""
    title = T.section_title("raw")
    keep = max(2, pages) - 1
    kept = sections.select("ord", title.alias("title")).filter("title <> ''").orderBy("ord").limit(keep)
    kept = kept.withColumn("ord", F.row_number().over(Window.orderBy("ord")))  # fewer rows than pages
    if topic:
        kept = kept.withColumn("title", F.when(F.col("ord") == 1, F.lit(f"{topic} · 背景与现状")).otherwise(F.col("title")))
    last = kept.agg((F.count("*") + 1).cast("int").alias("ord")).withColumn("title", F.lit("总结与下一步"))
    return kept.unionByName(last)


def term_sheet(terms: DataFrame) -> DataFrame:
    """name, text: each profile's terms (name, ord, term, meaning) in order, on a line."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term", "meaning"))), lambda x: F.concat(x.term, F.lit("："), F.coalesce(x.meaning, F.lit(""))))
    return terms.groupBy("name").agg(F.array_join(line, "；").alias("t")).select("name", F.concat(F.lit("【"), F.col("name"), F.lit("】"), F.col("t")).alias("text"))


def _bullets(title: str, items, line) -> Column:
    """A part of a profile's text: a heading and a bullet an item; nothing where there are none."""
    shown = F.concat(F.array(F.lit(f"\n## {title}\n")), F.transform(items, line))
    return F.when(F.size(F.coalesce(items, F.array())) > 0, shown).otherwise(F.array().cast("array<string>"))


def profile_entry(profiles: DataFrame) -> DataFrame:
    """name, text: a domain profile as a document. profiles: name, note, tri_ends, four_platforms and sources (arrays of
    strings), metrics and terms (arrays of struct<name,meaning>); parts that are null or empty are left out."""
    plain = lambda x: F.concat(F.lit("- "), x)
    defined = lambda x: F.concat(F.lit("- **"), x["name"], F.lit("**："), F.coalesce(x["meaning"], F.lit("")))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.array(F.concat(F.lit("> "), F.col("note"), F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.array(F.concat(F.lit("# "), F.col("name"), F.lit("\n"))), note)
    parts = [("三端", "tri_ends", plain), ("四平台", "four_platforms", plain), ("指标口径", "metrics", defined), ("术语口径", "terms", defined), ("权威来源", "sources", plain)]
    return profiles.select("name", F.array_join(F.concat(head, *[_bullets(title, F.col(c), line) for title, c, line in parts]), "\n").alias("text"))


def profile_hint(profiles: DataFrame, most: int = 12) -> DataFrame:
    """name, hint: a profile's rules in one line, to stand before a question; its first `most` terms by name."""
    short = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: T.strip(F.split(x, "[（(]")[0])), "、")
    names = lambda c, n: F.array_join(F.transform(n, lambda x: x["name"]), "、")
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    frame = F.when(some(F.col("tri_ends")) & some(F.col("four_platforms")), F.concat(F.lit("按「三端（"), short("tri_ends"), F.lit("）+ 四平台（"), short("four_platforms"), F.lit("）」的口径回答")))
    terms = F.when(some(F.col("terms")), F.concat(F.lit("术语按下述口径（释义以知识库原文为准）："), names("terms", F.slice("terms", 1, most))))
    metrics = F.when(some(F.col("metrics")), F.concat(F.lit("指标口径："), names("metrics", F.col("metrics"))))
    return profiles.select("name", F.concat_ws("；", frame, terms, metrics).alias("hint"))


def profile_terms(profiles: DataFrame) -> DataFrame:
    """name, ord, term: a profile's terms of 2 to 12 characters, the seeds of an entity graph."""
    kept = F.filter(F.transform(F.coalesce("terms", F.array().cast(profiles.schema["terms"].dataType)), lambda x: x["name"]), lambda x: F.char_length(x).between(2, 12))
    return profiles.select("name", F.posexplode(kept).alias("ord", "term"))
