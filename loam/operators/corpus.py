"""Corpus maintenance: statistics, deduplication, upsert, promotion, edits. Chunk tables are DataFrames; nothing is updated in place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import near
from loam.sources.scratch import written

MIN_CHARS = 8
NEAR = 0.97


def kb_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, sources, chars, tokens, with_vec, exact_dup."""
    # Distinct texts are counted by hash: texts themselves stay where they are.
    trimmed = F.md5(T.strip("text").cast("binary"))
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.countDistinct("source").alias("sources"),
        F.sum(F.char_length("text")).alias("chars"),
        F.sum(T.est_tokens("text")).alias("tokens"),
        F.count_if(F.col("embedding").isNotNull()).alias("with_vec"),
        (F.count(trimmed) - F.countDistinct(trimmed)).alias("exact_dup"),
    )


def scope_list(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """kb, chunks, sources of every known scope; a missing store counts 0."""
    held = chunks.groupBy("kb").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"))
    return scopes.join(held, "kb", "left").select("kb", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("sources", F.lit(0)).alias("sources"))


def source_recount(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("n"))


def drop_short(chunks: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    return chunks.filter(F.char_length(T.strip("text")) >= least)


def exact_dedup(chunks: DataFrame) -> DataFrame:
    """The first chunk of each trimmed text, with the sources of all in order of their first chunk (src_all, which replaces a
    column of that name). Null texts are equal among themselves, and to no other."""
    keyed, k = _keyed(chunks)
    return _restored(keyed, _firsts(keyed.select("chunk_ord", "source", k), k), k)


def _keyed(chunks: DataFrame) -> tuple[DataFrame, str]:
    """chunks without src_all, with a column of that name by which trimmed texts are equal."""
    chunks = chunks.drop("src_all")
    k = T.spare(chunks, "k")
    return chunks.withColumn(k, F.coalesce(F.sha2(T.strip("text").cast("binary"), 256), F.lit(""))), k


def _firsts(keys: DataFrame, k: str) -> DataFrame:
    """chunk_ord, k, src_all of the first chunk of each k: no text travels."""
    # A text's sources are few, however many its copies: they are reduced to one row each before they meet.
    by_source = keys.groupBy(k, F.col("source").alias("_s")).agg(F.min("chunk_ord").alias("o"))
    return by_source.groupBy(k).agg(F.min("o").alias("chunk_ord"), F.transform(F.array_sort(F.collect_list(F.struct("o", "_s"))), lambda x: x["_s"]).alias("src_all"))


def _restored(keyed: DataFrame, left: DataFrame, k: str) -> DataFrame:
    """The rows of keyed of left's chunk_ord and k, one each, with src_all: columns that nobody asks for don't travel."""
    out = keyed.join(left.select("chunk_ord", k, "src_all"), ["chunk_ord", k]).dropDuplicates(["chunk_ord", k])
    return out.select(*[c for c in keyed.columns if c != k], "src_all")


#: Vectors of a block: a task compares two blocks, some 128 MB of scores.
BLOCK_ROWS = 4096


def near_pairs(vectors: DataFrame, threshold: float = NEAR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b, sim of all pairs a < b of cosine above threshold. Each pair of blocks p <= q is one task of bounded size: the
    exact path, quadratic by nature, in which each vector is sent once for each block.

    Vectors that are null, empty, of length zero or hold null or non-finite components have no pairs; vectors meet only
    those of as many dimensions. Rows of one chunk_ord are no pair; an empty table gives no rows."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = vectors.filter(F.col("embedding").isNotNull()).select(F.col("chunk_ord").alias("i"), e.alias("e")).filter(~F.exists("e", lambda x: x.isNull() | F.isnan(x)))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, y: s + y * y))
    v = v.withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    v = v.select("i", F.size("e").alias("d"), F.transform("e", lambda x: x / F.col("norm")).alias("e"))
    last = max(1, -(-v.count() // block_rows)) - 1
    v = v.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(last + 1)).cast("int"))
    left = v.select("i", "e", "d", F.col("b").alias("p"), F.explode(F.sequence(F.col("b"), F.lit(last))).alias("q"))
    right = v.select(F.col("i").alias("j"), F.col("e").alias("f"), F.col("d").alias("d2"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("p2"), F.col("b").alias("q2"))

    def score(key, a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        s = np.array(a["e"].tolist()) @ np.array(b["f"].tolist()).T
        x, y = np.nonzero(s > threshold)
        i, j = a["i"].to_numpy()[x], b["j"].to_numpy()[y]
        keep = i < j if key[0] == key[1] else i != j
        return pd.DataFrame({"a": np.minimum(i, j)[keep], "b": np.maximum(i, j)[keep], "sim": s[x, y][keep]})

    return left.groupBy("p", "q", "d").cogroup(right.groupBy("p2", "q2", "d2")).applyInPandas(score, "a long, b long, sim double")


def near_dedup(chunks: DataFrame, threshold: float = NEAR) -> DataFrame:
    """Chunks that survive greedy near-dedup in order: one goes if an earlier survivor is nearer than threshold. Rows without
    a vector survive."""
    pairs = near.pairs(chunks, threshold).select(F.col("a").alias("early"), F.col("b").alias("late"))
    return chunks.join(near.gone(pairs).withColumnRenamed("n", "chunk_ord"), "chunk_ord", "left_anti")


def rebuild(chunks: DataFrame, threshold: float | None = NEAR) -> DataFrame:
    """Exact dedup, near dedup (unless threshold is None), short chunks out."""
    keyed, k = _keyed(chunks)
    # What decides is written once, without texts; these are read again for the rows that stay.
    size = T.spare(keyed, "size")
    held = ["chunk_ord", "source", k, *([] if threshold is None else ["embedding"])]
    slim = written(keyed.select(*held, F.char_length(T.strip("text")).alias(size)), "rebuild")
    left = slim.join(_firsts(slim, k), ["chunk_ord", k]).dropDuplicates(["chunk_ord", k])
    left = left if threshold is None else near_dedup(left, threshold)
    return _restored(keyed, left.filter(F.col(size) >= MIN_CHARS), k)


def incremental_skip(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources (src, n) of incoming that are not held as they are: only these need embedding."""
    return incoming.join(existing.select("src", "n"), ["src", "n"], "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks after an upsert by source hash: a source held with as many chunks stays, another is replaced, new ones follow."""
    held = existing.groupBy("src").agg(F.count("*").alias("n"))
    fresh = incremental_skip(held, incoming.groupBy("src").agg(F.count("*").alias("n"))).select("src")
    return existing.join(fresh, "src", "left_anti").unionByName(incoming.join(fresh, "src", "left_semi"), allowMissingColumns=True)


def promote(private: DataFrame, public: DataFrame, limit: int | None = None) -> DataFrame:
    """Private chunks whose text is not yet public, one of each text, in order. Texts meet by their hashes. A null text is
    equal to no public one, and null texts among themselves are one."""
    key = lambda df, name: df.withColumn(name, F.sha2(F.col("text").cast("binary"), 256))
    k = T.spare(private, "k")
    fresh = key(private, k).join(key(public, k).select(k).distinct(), k, "left_anti")
    fresh = fresh.groupBy(k).agg(F.min_by(F.struct(*private.columns), F.col("chunk_ord")).alias("c")).select("c.*")
    return fresh if limit is None else fresh.orderBy("chunk_ord").limit(limit)


def reindex_counts(chunks: DataFrame, force: bool = False) -> DataFrame:
    todo = F.lit(True) if force else F.col("embedding").isNull()
    return chunks.agg(F.count("*").alias("total"), F.count_if(todo).alias("to_embed"), F.count_if(~todo).alias("kept"))


def reindex(chunks: DataFrame, embed, force: bool = False) -> DataFrame:
    """Vectors for chunks that lack one (or all). embed: Column of texts -> Column of vectors."""
    text = T.embed_text("text", F.col("breadcrumb") if "breadcrumb" in chunks.columns else F.lit(""))
    return chunks.withColumn("embedding", F.when(F.lit(force) | F.col("embedding").isNull(), embed(text)).otherwise(F.col("embedding")))


def edit(chunks: DataFrame, changes: DataFrame, at: str, note: str = "edit") -> DataFrame:
    """chunks with the texts of changes (kb, chunk_ord, new_text); the old text becomes the next revision. Of several changes
    of one chunk the one of the greatest text counts; changes of chunks that aren't there, or to null, change nothing."""
    changes = changes.groupBy("kb", "chunk_ord").agg(F.max("new_text").alias("new_text"))
    rev = F.struct((F.size(F.coalesce("revs", F.array().cast(chunks.schema["revs"].dataType))) + 1).alias("v"), F.col("text"), F.lit(at).alias("at"), F.lit(note).alias("note"))
    out = chunks.join(changes, ["kb", "chunk_ord"], "left")
    changed = F.col("new_text").isNotNull() & (F.col("new_text") != F.col("text"))
    revs = F.coalesce("revs", F.array().cast(chunks.schema["revs"].dataType))
    out = out.withColumn("revs", F.when(changed, F.concat(revs, F.array(rev))).otherwise(revs)).withColumn("text", F.when(changed, F.col("new_text")).otherwise(F.col("text")))
    return out.select(*chunks.columns)


def rollback(chunks: DataFrame, wanted: DataFrame, at: str) -> DataFrame:
    """Back to revision v of each (kb, chunk_ord, v): the text shown becomes a revision too."""
    old = chunks.join(wanted, ["kb", "chunk_ord"]).select("kb", "chunk_ord", F.filter("revs", lambda r: r.v == F.col("v"))[0].text.alias("new_text"))
    return edit(chunks, old, at, "rollback")


def editor_stats(chunks: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("revs"), F.lit(0))
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(n > 0).alias("edited"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("revs"))


def rev_numbering(revs: DataFrame) -> DataFrame:
    """revs (kb, chunk_ord, at, …) with v from 1 in order of time."""
    return revs.withColumn("v", F.row_number().over(Window.partitionBy("kb", "chunk_ord").orderBy("at")))


def bulk_replace(chunks: DataFrame, find: str, put: str) -> DataFrame:
    """chunks with text replaced, n (occurrences) and residual (whether some are left, as when put contains find)."""
    n = (F.char_length("text") - F.char_length(F.replace("text", F.lit(find), F.lit("")))) / len(find)
    out = chunks.withColumn("n", F.floor(n).cast("long")).withColumn("text", F.replace("text", F.lit(find), F.lit(put)))
    return out.withColumn("residual", F.contains("text", F.lit(find)))


def unique_slugs(names: DataFrame) -> DataFrame:
    """names (ord, name) with slug: in order, each name's slug, or the first free one of slug2, slug3, ….

    Only slugs that agree but for digits at their end can clash, so these are dealt out together. A null or empty name is
    `item`; an empty table gives no rows."""
    s, root = T.spare(names, "s"), T.spare(names, "root")
    base = F.when(F.coalesce(T.slugify("name"), F.lit("")) == "", "item").otherwise(T.slugify("name"))
    rows = names.withColumn(s, base).withColumn(root, F.regexp_replace(s, "[0-9]+$", ""))

    def allot(pdf):
        # Slugs are never given back, so a name's search goes on where its last one ended.
        taken, free, out = set(), {}, []
        pdf = pdf.sort_values(["ord", s], kind="stable")
        for name in pdf[s]:
            k, slug = free.get(name, 2), name
            while slug in taken:
                k, slug = k + 1, f"{name}{k}"
            taken.add(slug)
            free[name] = k
            out.append(slug)
        return pdf.drop(columns=[s, root]).assign(slug=out)

    from pyspark.sql import types as Y

    return rows.groupBy(root).applyInPandas(allot, Y.StructType([*names.schema.fields, Y.StructField("slug", Y.StringType())]))


def replace_in_json(rows: DataFrame, find: str, put: str, column: str = "json") -> DataFrame:
    """rows with find replaced in every string value, at any depth, of the JSON in a column; n (occurrences) and residual
    (whether some are left). Keys stay; what is no JSON, or null, stays as it is, with n 0."""
    import json

    def walk(value, count):
        if isinstance(value, str):
            count[0] += value.count(find)
            return value.replace(find, put)
        if isinstance(value, list):
            return [walk(x, count) for x in value]
        return {k: walk(x, count) for k, x in value.items()} if isinstance(value, dict) else value

    @F.pandas_udf("text string, n long, residual boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            count, left = [0], [0]
            try:
                new = walk(json.loads(text), count)
                walk(new, left)
                text = json.dumps(new, ensure_ascii=False) if count[0] else text
            except (TypeError, ValueError):
                pass
            out.append((text, count[0], left[0] > 0))
        return pd.DataFrame(out, columns=["text", "n", "residual"])

    done = T.spare(rows, "done")
    return rows.withColumn(done, run(column)).withColumns({column: F.col(f"{done}.text"), "n": F.col(f"{done}.n"), "residual": F.col(f"{done}.residual")}).drop(done)


def chunk_search(chunks: DataFrame, q: str, limit: int = 50) -> DataFrame:
    hit = F.contains("text", F.lit(q))
    if "breadcrumb" in chunks.columns:
        hit = hit | F.coalesce(F.contains("breadcrumb", F.lit(q)), F.lit(False))
    return chunks.filter(hit).orderBy("chunk_ord").limit(limit)


def source_filter_fallback(hits: DataFrame, picked: list[str]) -> DataFrame:
    """Hits of the picked sources, or all of them where none is."""
    found = T.spare(hits, "found")
    some = hits.agg(F.coalesce(F.bool_or(F.col("source").isin(picked)), F.lit(False)).alias(found))
    return hits.crossJoin(F.broadcast(some)).filter(F.col("source").isin(picked) | ~F.col(found)).drop(found)


def diff(old: str, new: str) -> dict:
    """Unified difference with two lines of context, and the similarity ratio: two short texts, on the driver."""
    import difflib

    lines = difflib.unified_diff(old.splitlines(), new.splitlines(), "old", "new", n=2, lineterm="")
    return {"diff": "\n".join(lines), "ratio": difflib.SequenceMatcher(None, old, new).ratio()}
