"""Homomorphic multiset fingerprints of documents (DataFrame operations only).

A text is the multiset of its paragraphs; a long paragraph counts as its sentences. Each piece is hashed to a wide vector
and a document's fingerprint is the sum of its pieces' vectors modulo powers of two, so it doesn't depend on their order,
and the vector of a piece inserted or deleted is added or subtracted. The vector has two parts: 8 dense lanes modulo
2^32, for equality, and 1024 sparse lanes modulo 2^8 of which a piece touches one, for likeness. Sparse lanes are 32 levels
of 32; a piece's level is the number of trailing zeros of its hash, so each level holds half as many as the one before,
and no text has too many pieces for the last. Lanes other than 0 are written as number and value, five hex digits
together. inserted() and deleted() add and subtract fingerprints lane by lane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.shared import table, texts

DENSE, LEVELS, LANES = 4, 32, 32
#: Likeness is read from the first level of which at most this many lanes are other than 0, and those above.
FEW = 20
PIECES = r" (?<=[.!?] )|(?<=\n)"


def pieces(text):
    """Non-empty paragraphs and sentences; an empty text has none."""
    return F.filter(F.split(text, PIECES, -1), lambda x: x != "")


def bucket_of(col, bounds: list[int]):
    """How many bounds are at most col: a two-level search, so some 2 * sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(firsts, lambda x: x <= col))
    inside = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    within = F.size(F.filter(F.get(inside, group - 1), lambda x: x <= col))
    return F.when(group == 0, 0).otherwise((group - 1) * step + within)


def ordered(docs: DataFrame, buckets: int) -> DataFrame:
    """docs with bucket and rn: ascending (bucket, rn) is descending doc_id, nulls last, ties by text hash."""
    bounds = []
    if buckets > 1:
        found = docs.filter(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
        bounds = sorted(set(found or []))
    b = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - bucket_of(F.col("doc_id"), bounds))
    return docs.withColumn("bucket", b)


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, bucket, rn and next_text, the text of the next document in descending doc_id; the last one's is the first's."""
    base = ordered(texts(docs), buckets)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    key = F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1)).alias("i"), F.xxhash64("text").alias("h"))
    heads = base.groupBy("bucket").agg(F.min_by("text", key).alias("head"))
    # A row for each bucket, as many as shuffle partitions.
    around = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(Window.orderBy("bucket")), F.first("head").over(around)).alias("after"))
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = base.withColumn("rn", F.row_number().over(w)).withColumn("lead", F.lead("text").over(w))
    return rows.join(heads, "bucket").select("doc_id", "text", "bucket", "rn", F.coalesce("lead", "after").alias("next_text"))


def summed(rows: DataFrame, keys: list[str], units: str) -> DataFrame:
    """For each of the keys dense (8 lanes), used (lanes other than 0, ascending, each as number * 256 + value) and few, the
    level from which likeness is read. rows: keys and an array of pieces."""
    h = F.xxhash64("piece")
    some = F.col("piece").isNotNull()
    # Trailing zeros, of the last level at most. Lanes and values come from higher bits.
    capped = F.col("h").bitwiseAND(F.lit((1 << LEVELS) - 1)).bitwiseOR(F.lit(1 << (LEVELS - 1)))
    level = F.bit_count(F.bitwise_not(capped).bitwiseAND(capped - 1))
    low = F.lit(0xFFFFFFFF)
    hashed = rows.select(*keys, F.explode_outer(units).alias("piece")).select(*keys, some.alias("some"), h.alias("h"), *[F.xxhash64(F.lit(i + 1), F.col("piece")).alias(f"x{i}") for i in range(DENSE)])
    lanes = [f"d{i}" for i in range(2 * DENSE)]
    split = hashed.select(
        *keys,
        F.when(F.col("some"), level * LANES + F.shiftrightunsigned("h", 48).bitwiseAND(F.lit(LANES - 1)).cast("int")).alias("slot"),
        F.when(F.col("some"), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(0xFFFF))).otherwise(0).alias("v"),
        *[F.when(F.col("some"), F.col(f"x{i}").bitwiseAND(low) if k == 0 else F.shiftrightunsigned(f"x{i}", 32)).otherwise(0).alias(f"d{2 * i + k}") for i in range(DENSE) for k in range(2)],
    )
    by_slot = split.groupBy(*keys, "slot").agg(F.sum("v").alias("v"), *[F.sum(d).alias(d) for d in lanes])
    v = (F.col("v") % 256).cast("int")
    at = [F.count_if((v != 0) & (F.col("slot") >= j * LANES) & (F.col("slot") < (j + 1) * LANES)).alias(f"c{j}") for j in range(LEVELS - 1)]
    whole = by_slot.groupBy(*keys).agg(F.collect_list(F.when(F.col("slot").isNotNull() & (v != 0), F.col("slot") * 256 + v)).alias("used"), *[F.sum(d).alias(d) for d in lanes], *at)
    few = F.coalesce(*[F.when(F.col(f"c{j}") <= FEW, j) for j in range(LEVELS - 1)], F.lit(LEVELS - 1))
    return whole.select(*keys, F.array(*[F.col(d) % (1 << 32) for d in lanes]).alias("dense"), F.array_sort("used").alias("used"), few.alias("few"))


def as_hex(dense, used):
    pad = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(F.array_join(F.transform(dense, lambda x: pad(x, 8)), ""), F.lit("."), F.array_join(F.transform(used, lambda x: pad(x, 5)), ""))


def _merged(a, b, sign: int):
    """The fingerprint whose lanes are those of a plus, or minus, those of b."""
    number = lambda col, at, n: F.conv(F.substring(col, at, F.lit(n)), 16, 10).cast("long")
    dense = F.transform(F.sequence(F.lit(0), F.lit(2 * DENSE - 1)), lambda i: F.pmod(number(a, i * 8 + 1, 8) + sign * number(b, i * 8 + 1, 8), F.lit(1 << 32)))

    def lanes(col):
        listed = F.substring_index(col, ".", -1)
        each = F.transform(F.when(listed != "", F.sequence(F.lit(0), F.floor(F.length(listed) / 5).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: number(listed, i * 5 + 1, 5))
        return F.map_from_entries(F.transform(each, lambda x: F.struct(F.floor(x / 256), x % 256)))

    held = F.map_zip_with(lanes(a), lanes(b), lambda k, x, y: F.pmod(F.coalesce(x, F.lit(0)) + sign * F.coalesce(y, F.lit(0)), F.lit(256)))
    used = F.array_sort(F.transform(F.filter(F.map_entries(held), lambda e: e.value != 0), lambda e: e.key * 256 + e.value))
    return as_hex(dense, used)


def inserted(fingerprint, part):
    """The fingerprint of a text with more pieces in it: part is the fingerprint of these. Null if either is."""
    return _merged(fingerprint, part, 1)


def deleted(fingerprint, part):
    """The fingerprint of a text without some of its pieces: part is the fingerprint of these. Null if either is."""
    return _merged(fingerprint, part, -1)


def likeness(used_a, few_a, used_b, few_b):
    """0 to 1: equal lanes among the lanes in use, from the first level on where both texts use few; an estimate of the
    share of pieces that the two have in common."""
    least = F.greatest(few_a, few_b) * (LANES * 256)
    a, b = F.filter(used_a, lambda x: x >= least), F.filter(used_b, lambda x: x >= least)
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def fingerprints(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """keep columns (they must tell rows apart) and fingerprint of every row. Null or empty text: the zero fingerprint."""
    rows = docs.select(*keep, pieces(F.coalesce(F.col(text), F.lit(""))).alias("units"))
    return summed(rows, list(keep), "units").select(*keep, as_hex(F.col("dense"), F.col("used")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document beside its edited text (see op9) and the next document.

    Null text counts as empty; a document alone in the table is its own next one; rows with equal doc_id and text are
    documents of their own; null doc_id comes last in the order; an empty table gives no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, buckets).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), pieces(F.col(c)).alias("units")) for i, c in enumerate(("text", "edited", "next_text"))])
    keys = ["bucket", "rn", "doc_id", "n_chars", "edited_sha256", "side"]
    flat = rows.select("bucket", "rn", "doc_id", "n_chars", sha.alias("edited_sha256"), F.inline(sides))
    sums = summed(flat, keys, "units").withColumn("print", F.struct("dense", "used", "few"))
    side = [F.max(F.when(F.col("side") == i, F.col("print"))).alias(f"p{i}") for i in range(3)]
    wide = sums.groupBy(*keys[:-1]).agg(*side)

    def near(i):
        other = F.col(f"p{i}")
        return F.when(F.col("p0") == other, 1.0).otherwise(likeness(F.col("p0.used"), F.col("p0.few"), other.used, other.few))

    shown = lambda i: as_hex(F.col(f"p{i}.dense"), F.col(f"p{i}.used"))
    return wide.select("doc_id", "n_chars", "edited_sha256", shown(0).alias("fingerprint"), shown(1).alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
