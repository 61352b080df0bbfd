"""Language ID by compression: the language whose raw-content zstandard dictionary makes a text smallest."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.shared import crc_mod, table

#: What the dictionaries are fitted on, a bounded sample of labelled rows: in each of BUCKETS buckets (by hash) the
#: SAMPLE_ROWS different texts of least hash, and of these, by hash, as many whole ones as fit LANG_BYTES bytes a language.
#: More than LANGUAGES different labels are refused: each is tried on every text.
BUCKETS, SAMPLE_ROWS, LANG_BYTES, LANGUAGES = 32, 4, 1 << 17, 500
#: Texts are compressed in blocks of so many bytes, so that a text's own beginning doesn't stand in for the dictionary.
BLOCK = 4096
#: A lazy match finder of small tables: deep enough to find words of the dictionary, quick enough for every language.
SEARCH = {"compression_level": 9, "strategy": 5, "min_match": 4, "window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 4, "target_length": 32}
#: A text is rejected if the best language saves less than this share on the second-best: sizes are all but equal.
MARGIN = 0.002
#: Or if the best language's dictionary saves less than this share on compressing without one: no language learned.
SAVES = 0.01
#: But not if its different words come to fewer bytes than this: they are too few to tell.
TELLING = 200
HELD_OUT = (4, 2)


def fit(labelled: DataFrame, seed: int = 0) -> dict[str, bytes]:
    """lang -> dictionary content, from rows of text and lang. Rows without text, letters or lang teach nothing; texts of any
    length may be drawn, and equal texts of a language count once; an empty table teaches no language. More than LANGUAGES
    different langs raise an error."""
    telling = F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))
    rows = labelled.filter(telling).select("lang", "text", F.xxhash64(F.lit(seed), F.col("text")).alias("h"))
    known = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if known > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different languages")
    w = Window.partitionBy("lang", F.pmod("h", F.lit(BUCKETS))).orderBy("h")
    # Hashes and lengths alone are shuffled and chosen from; the texts of the chosen ones are fetched.
    drawn = rows.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("size")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SAMPLE_ROWS)
    sizes: dict[str, list] = {}
    for r in drawn.collect():  # at most BUCKETS * SAMPLE_ROWS rows of numbers a language
        sizes.setdefault(r.lang, []).append((r.h, r.size))
    chosen = [(lang, h) for lang, held in sizes.items() for h in _within(sorted(held))]
    wanted = labelled.sparkSession.createDataFrame(chosen, "lang string, h long")
    # One text that alone is over the budget is cut in its own row, before it travels.
    taken = rows.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, LANG_BYTES)).alias("text"))
    found: dict[str, list] = {}
    for r in taken.collect():  # some LANG_BYTES a language
        found.setdefault(r.lang, []).append((r.h, r.text))
    return {lang: b"\n".join(text.lower().encode() for _, text in sorted(held)) for lang, held in sorted(found.items())}


def _within(rows: list[tuple[int, int]]) -> list[int]:
    """The hashes of the texts (hash, bytes) that together fit LANG_BYTES with a line end each: one that doesn't is passed
    over, but where none fits the first is taken, and will be cut."""
    out, size = [], 0
    for h, n in rows:
        if size + n + 1 <= LANG_BYTES:
            out.append(h)
            size += n + 1
    return out or [h for h, _ in rows[:1]]


def different(raw: bytes) -> bytes:
    """The different words of a text, in order, with a blank before and after each."""
    return b" " + b" ".join(dict.fromkeys(raw.split())) + b" "


def trigrams(raw: bytes) -> tuple[dict[bytes, float], float]:
    """Cost in bits of each trigram of a dictionary, and of one that it lacks."""
    raw = b" " + b" ".join(raw.split()) + b" "
    counts = Counter(raw[i : i + 3] for i in range(len(raw) - 2))
    total = math.log2(sum(counts.values()) + 1)
    return {g: total - math.log2(n + 0.5) for g, n in counts.items()}, total + 1


def bits(words: bytes, model: tuple[dict[bytes, float], float]) -> float:
    known, unknown = model
    return sum(known.get(words[i : i + 3], unknown) for i in range(len(words) - 2))


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected added (columns of those names are replaced).

    Null texts, texts without a letter, and all texts where nothing was learned are `und` with score 0, and rejected.
    score is the share by which the best language beats the second (1 where only one was learned). Languages of equal
    size are told apart by the cost of the text's different words in bits, by the dictionaries' trigrams; if that is
    equal, too, the language first in order wins. rejected where score is under margin or the best dictionary saves less
    than SAVES, on the text and on its letters alone, unless these are too few to tell (TELLING). Equal texts get equal
    results.
    """
    keep = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        from functools import cache

        import pyarrow as pa
        import regex
        import zstandard

        letter, other = regex.compile(r"\p{L}").search, regex.compile(r"[^\p{L}\p{M}]+").sub
        total = lambda coder, blocks: sum(len(coder.compress(b)) for b in blocks)
        search = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        langs, coders = [], []
        for lang, raw in shared.value.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=search)
            langs.append(lang)
            coders.append(zstandard.ZstdCompressor(compression_params=search, dict_data=d))
        none = zstandard.ZstdCompressor(compression_params=search)
        models = cache(lambda: [trigrams(raw) for raw in shared.value.values()])
        for batch in batches:
            pred, score, rejected = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                if not langs or text is None or not letter(text):
                    out = ("und", 0.0, True)
                else:
                    raw = text.lower().encode()
                    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
                    sizes = sorted((total(c, blocks), k) for k, c in enumerate(coders))
                    best = sizes[0][0]
                    tied = [k for size, k in sizes if size == best]
                    if len(tied) > 1:
                        words = different(raw)
                        sizes = sorted((bits(words, models()[k]), k) for k in tied)
                    s = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]
                    first = sizes[0][1]
                    bad = s < margin
                    if bad or best > (1 - SAVES) * total(none, blocks):
                        # Marks between words hide what a dictionary saves: letters alone are judged.
                        plain = other(" ", text.lower()).encode()
                        cut = [plain[i : i + BLOCK] for i in range(0, len(plain), BLOCK)]
                        bad = (bad or total(coders[first], cut) > (1 - SAVES) * total(none, cut)) and len(different(plain)) >= TELLING
                    out = (langs[first], s, bad)
                for x, y in zip((pred, score, rejected), out):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return keep.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(HELD_OUT[0]) == HELD_OUT[1]
    dictionaries = fit(docs.filter(~held).select("text", "lang"))
    out = classify(docs.select("doc_id", "text"), dictionaries).drop("text")
    return out.select("doc_id", (crc_mod(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "lang_pred", "score", "rejected")
