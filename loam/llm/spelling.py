"""Spelling variants: words one edit apart, found by groups instead of pairs.

Each word names its groups: for every position the words that agree with it everywhere else (a wildcard: position, what
stands before, what stands behind), itself, and what is left of it without each of its characters. A wildcard group has at most
one word for each character of the alphabet and keeps its size and its two most frequent words, so each member knows how many
neighbours it has there and which is the best other one. The deletions of a word meet the vocabulary under one name: the word
that stands there learns of those with a character more, and they of it. Sums and best ones of a word's groups are its own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.shared import table, texts, written
from loam.llm.words import mix

RUN = "[a-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO, DELETE_EVERY = 7, 2, 10, 31
#: Different words that a task counts before it passes them on, and characters of words whose groups it names at a time.
HELD_WORDS, STEP_CHARS = 1 << 17, 1 << 16
WILDCARD, SELF, DELETION = 0, 1, 2
_LANES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, that occur min_count times or more in all texts and have min_length
    characters or more. Where delete_every divides the crc32 of `<doc_id>:<run>`, that run of that document loses the
    character at the crc32's remainder by its length (0: none does). Null texts have no runs; a null doc_id counts as
    empty text; repeated rows count each; an empty table has no words."""
    runs = re.compile(RUN)

    def count(batches):
        import pyarrow as pa

        held: dict[str, int] = {}

        def close():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch["name"].to_pylist(), batch["text"]):
                seed = zlib.crc32(f"{name}:".encode())
                own: dict[str, int] = {}
                # bytes.lower() knows A-Z only.
                for m in runs.finditer(text.as_buffer().to_pybytes().lower().decode()):
                    if m.end() - m.start() >= min_length:
                        own[m[0]] = own.get(m[0], 0) + 1
                for run, n in own.items():
                    h = zlib.crc32(run.encode(), seed)
                    if delete_every and h % delete_every == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                        if len(run) < min_length:
                            continue
                    held[run] = held.get(run, 0) + n
                if len(held) >= HELD_WORDS:
                    yield close()
        yield close()

    named = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def group_keys(words: list[str]):
    """(owner, kind, key lanes) of all groups of all words, in any order. A word's hash is the sum of those of its characters
    and places, so leaving one out or moving the rest up by one needs no copy of the word."""
    n = np.array([len(w) for w in words], np.int64)
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), n)
    start = np.cumsum(n) - n
    j = np.arange(len(c)) - start[owner]
    size, at = n[owner].astype(np.uint64), j.astype(np.uint64)
    differs = (j == 0) | (c != np.concatenate([c[:1], c[:-1]]))  # of equal neighbours only the first is deleted
    keys = []
    for seed in _LANES:
        here = mix(c * seed + mix(at + seed))
        moved = mix(c * seed + mix(at - np.uint64(1) + seed))
        upto, upto_moved = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (here, moved))
        whole = upto[start + n] - upto[start]
        name = lambda h, length: mix(h + mix(length * seed + np.uint64(SELF)))
        left = (upto[:-1] - upto[start[owner]]) + (upto_moved[(start + n)[owner]] - upto_moved[1:])
        wild = mix(whole[owner] - here + mix(mix(size * seed) + (at << np.uint64(2)) + np.uint64(DELETION)))
        keys.append(np.concatenate([wild, name(whole, n.astype(np.uint64)), name(left, size - np.uint64(1))[differs]]))
    kinds = np.repeat(np.array([WILDCARD, SELF, DELETION], np.int32), [len(c), len(words), int(differs.sum())])
    return np.concatenate([owner, np.arange(len(words)), owner[differs]]), kinds, keys


def grouped(words: DataFrame) -> DataFrame:
    """word, n, kind, k1, k2: a row for each group that a word is in."""

    def name(batches):
        import pyarrow as pa

        for batch in batches:
            held, size, first = batch["word"].to_pylist(), 0, 0
            for i, w in enumerate(held):
                size += len(w)
                if size >= STEP_CHARS or i + 1 == len(held):
                    owner, kinds, keys = group_keys(held[first : i + 1])
                    rows = batch.slice(first, i + 1 - first).take(pa.array(owner))
                    yield pa.RecordBatch.from_arrays([rows["word"], rows["n"], pa.array(kinds), *(pa.array(k.view(np.int64)) for k in keys)], ["word", "n", "kind", "k1", "k2"])
                    size, first = 0, i + 1

    return words.select("word", "n").mapInArrow(name, "word string, n long, kind int, k1 long, k2 long")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (neg_n, word): how many words differ from a word by one inserted, deleted or replaced character, and
    the most frequent of them (ties: the first in code-point order). Words without any have no row."""
    me = F.struct((-F.col("n")).alias("neg_n"), F.col("word").alias("word"))
    group = Window.partitionBy("k1", "k2").orderBy("me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_self, is_deletion = F.col("kind") == SELF, F.col("kind") == DELETION
    held = grouped(words).select("word", "kind", "k1", "k2", me.alias("me")).select(
        "word", "kind", "me", F.count("*").over(group).alias("size"), F.nth_value("me", 1).over(group).alias("one"), F.nth_value("me", 2).over(group).alias("two"),
        F.count_if(is_deletion).over(group).alias("longer"), F.first(F.when(is_deletion, F.col("me")), True).over(group).alias("best_longer"), F.first(F.when(is_self, F.col("me")), True).over(group).alias("shorter"))
    other = F.when(F.col("one.word") != F.col("word"), F.col("one")).otherwise(F.col("two"))
    near = F.when(F.col("kind") == WILDCARD, F.col("size") - 1).when(is_self, F.col("longer")).otherwise(F.col("shorter").isNotNull().cast("long"))
    best = F.when(F.col("kind") == WILDCARD, other).when(is_self, F.col("best_longer")).otherwise(F.col("shorter"))
    return held.filter("size > 1").select("word", near.alias("near"), best.alias("best")).filter("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root for links (word, form): where following the forms ends. Every round halves what is left of the chains,
    whose length is the logarithm of the counts at most, since counts grow by the ratio with each form."""
    held = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        held = written(held.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if held.filter("moved").isEmpty():
            return held.select("word", "root")
        held = held.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, delete_every: int = DELETE_EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of vocabulary().

    form: the most frequent word (ties: the first in code-point order) that differs by exactly one inserted, deleted or
    replaced character, if it occurs at least `ratio` (2 or more) times as often; else null, and form_n too. root: where
    following the forms ends, the word itself if it has none. n_near: how many such neighbours there are. Words of any length
    and any number of equal counts are told apart; groups are keyed by 128 bits. Odd documents: see vocabulary(). Other columns
    are ignored."""
    if ratio < 2:
        raise ValueError("ratio is 2 or more")
    words = written(vocabulary(docs, min_length, min_count, delete_every), "words")
    near = words.join(neighbours(words), "word", "left")
    form_n = -F.col("best.neg_n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n >= ratio * F.col("n"), F.col("best.word")).alias("form"), F.when(form_n >= ratio * F.col("n"), form_n).alias("form_n"))
    near = written(near, "variants")
    ends = roots(near.filter("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 of the bytes of column x of the table {of}, with all columns of that table: a bit at a time is too slow, so a list
#: of 256 remainders is made first, then applied to the bytes in turn.
CRC_SQL = """
crc_rest AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS rest FROM range(256) t(i)),
{of}_crc AS (SELECT {of}.*, xor(list_reduce([4294967295] || list_transform(range(0, octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT),
            lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM {of}, crc_rest)
"""
SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
q AS (SELECT doc_id || ':' || run AS x, run, count(*) AS many FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
{CRC_SQL.format(of="q")},
w AS (SELECT CASE WHEN crc % 31 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, many FROM q_crc),
v AS (SELECT word, sum(many)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(many) >= 2),
cut AS (SELECT DISTINCT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
del AS (SELECT DISTINCT word, n, rest FROM cut),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
         UNION ALL SELECT del.word, v.word, v.n FROM del JOIN v ON del.rest = v.word
         UNION ALL SELECT v.word, del.word, del.n FROM del JOIN v ON del.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON f.word = ends.word
"""
