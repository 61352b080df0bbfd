"""MinHash near-dedup with odd sketches.

1. Every text becomes a sketch: the size and hash of its set of shingles, MinHash bands, and an odd sketch: MinHash samples
   folded into a bitmap by parity, so that the ones in the exclusive or of two bitmaps tell how many samples differ. The
   samples are the whole set where it is small (any permutation's least SMALL hashes), else the least hash in each of BINS
   bins. Equal sets are one class from here on.
2. Classes that share a band are candidates. A bucket may hold any number of them, so its members are first compared
   with one member, the bucket's hub; each class goes on with the hub that its odd sketch says is nearest. What is linked
   so forms components. Then the members outside a bucket's largest component are compared with all others that are
   still apart from them, so no candidate link between components is lost, and no pair within one is made. Members meet
   only others of like size, and a bucket that would make too many pairs is dealt to several keys.
3. A candidate goes on only if the sizes and the odd sketches allow the similarity: those of whole sets can't err, as there
   are never more ones than differing shingles; those of samples have to be within FAR standard deviations of it. It is
   then confirmed on the full sets of shingles, word by word and not by hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.shared import bounded, slices, spare, table, written
from loam.llm.words import exact_sets, mix, shingles, steps

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair of similarity 0.75 shares none of the bands with probability (1 - 0.75 ** ROWS) ** BANDS, 3e-7.
BANDS, ROWS = 40, 4
#: Samples and bits of the odd sketch; and how far under the threshold, in standard deviations, an estimate may be.
BINS, BITS, FAR = 1 << 10, 1 << 11, 5
#: Sets of at most so many shingles are sampled whole. Those of more than three quarters of it are sampled by bins, so that
#: any two that may be linked have one kind of sketch in common.
SMALL = 1 << 10
#: Rounds of comparisons with hubs.
HUBS = 2
#: Pairs that a key of the last comparison may make before its bucket is dealt to more keys.
KEY_PAIRS = 1 << 22
#: Bytes of texts whose exact sets are held at a time.
CONFIRM_BYTES = 1 << 24

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.int64).astype(np.uint32)
#: What is known of a class without its text.
SKETCH = ["n", "odd", "filled", "bins"]


def differing(ones: int) -> float:
    """How many samples of two odd sketches differ, estimated from the ones in their exclusive or."""
    return -BITS / 2 * math.log(max(1 - 2 * ones / BITS, 1e-9))


def bitmaps(doc, bit, docs: int):
    """Of each text the parities of its bits, as longs."""
    parity = np.bincount(doc * BITS + bit.astype(np.int64), minlength=docs * BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(docs, BITS), axis=1, bitorder="little").view(np.int64)


def odd_sketch(s, n):
    """Bitmaps of the whole sets of texts, whose different shingle hashes s lie one after the other, n a text."""
    return bitmaps(np.repeat(np.arange(len(n)), n), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(BITS - 1), len(n))


def binned_sketch(s, n):
    """(samples, bitmaps) of texts whose shingle hashes s lie one after the other, n a text."""
    docs = len(n)
    owner = np.repeat(np.arange(docs, dtype=np.uint64), n)
    # Text, bin and hash in one number: the least of each text and bin comes first in order.
    low = np.uint64((1 << 34) - 1)
    key = np.sort((owner << np.uint64(44)) | ((s >> np.uint64(54)) << np.uint64(34)) | (mix(s) & low))
    slot = key >> np.uint64(34)
    least = key[np.concatenate([[True], slot[1:] != slot[:-1]])] if len(key) else key
    doc = (least >> np.uint64(44)).astype(np.int64)
    bit = mix(least & np.uint64((1 << 44) - 1)) & np.uint64(BITS - 1)
    return np.bincount(doc, minlength=docs), bitmaps(doc, bit, docs)


def sketch(texts: list[bytes]):
    """For each text: set size, two set hashes, bands, odd sketch of the whole set, samples by bins and their odd sketch."""
    lanes, n = shingles(texts, WORDS)
    s = np.ascontiguousarray(lanes[:, 0])
    docs = len(texts)
    size, k1, k2 = np.zeros(docs, np.int64), np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
    bands = np.zeros((docs, BANDS), np.uint64)
    at = np.concatenate([[0], np.cumsum(n)])
    sets = [s[:0]] * docs
    for i in np.flatnonzero(n):
        u, row = np.unique(s[at[i] : at[i + 1]], return_index=True)
        size[i], k1[i], k2[i] = len(u), mix(u).sum(dtype=np.uint64), mix(lanes[at[i] + row, 1]).sum(dtype=np.uint64)
        sets[i] = u
    some = np.flatnonzero(n)
    if len(some):
        h, starts = (s >> np.uint64(32)).astype(np.uint32), at[:-1][some]
        mins = np.empty((len(some), BANDS * ROWS), np.uint32)
        for p in range(BANDS * ROWS):
            mins[:, p] = np.minimum.reduceat(h * _A[p] + _B[p], starts)
        wide = mins.astype(np.uint64).reshape(len(some), BANDS, ROWS)
        b = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(some), BANDS)).copy()
        for r in range(ROWS):
            b = mix(b * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
        bands[some] = b
    small, large = np.flatnonzero(size <= SMALL), np.flatnonzero(size * 4 > SMALL * 3)
    odd, bins = np.zeros((docs, BITS // 64), np.int64), np.zeros((docs, BITS // 64), np.int64)
    filled = np.zeros(docs, np.int64)
    pick = lambda which: (np.concatenate([s[:0], *(sets[i] for i in which)]), size[which])
    odd[small] = odd_sketch(*pick(small))
    filled[large], bins[large] = binned_sketch(*pick(large))
    return size, k1.view(np.int64), k2.view(np.int64), bands.view(np.int64), odd, filled, bins


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n (size of the set), k1, k2, bands, odd, filled, bins (odd, or filled and bins, null or
    0 where the other kind is enough)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def lists(x, some=None):
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            return held if some is None else pc.if_else(pa.array(some), held, pa.scalar(None, held.type))

        names = ["doc_id", "th", "n", "k1", "k2", "bands", "odd", "filled", "bins"]
        for batch in batches:
            for first, raw in steps(batch.column(2)):
                n, k1, k2, bands, odd, filled, bins = sketch(raw)
                held = batch.slice(first, len(raw))
                yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array(n), pa.array(k1), pa.array(k2), lists(bands), lists(odd, n <= SMALL), pa.array(filled, pa.int32()), lists(bins, n * 4 > SMALL * 3)], names)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return base.mapInArrow(run, "doc_id long, th long, n long, k1 long, k2 long, bands array<long>, odd array<long>, filled int, bins array<long>")


def of(side: str) -> list:
    """A class's sketch, named for a side of a pair."""
    return [F.col(c).alias(c + side) for c in SKETCH]


def ones(kind: str):
    return F.aggregate(F.zip_with(kind + "a", kind + "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def both_small():
    return F.greatest("na", "nb") <= SMALL


def likely():
    """Whether sizes and odd sketches leave it possible that sides a and b are similar enough.

    At the threshold t the two sets' union has (na + nb) / (1 + t) shingles, of which a share 1 - t is in one set only: whole
    sets' sketches may have no more ones than that. Samples by bins: the union fills u bins, and of these a share t has
    equal samples; nearer sets have more. The variance is that of sampling (little where most shingles are sampled), of how
    many bins the union fills, and of the parity bitmap."""
    t = PERCENT / 100
    near = ones("odd") * (100 + PERCENT) <= (F.col("na") + F.col("nb")) * (100 - PERCENT)
    union = (F.col("na") + F.col("nb")) / (1 + t)
    load = union / BINS
    u = BINS * (1 - F.exp(-load))
    fill = BINS * (F.exp(-load) - (1 + load) * F.exp(-2 * load))
    z = F.least(F.lit(BITS / 2 - 1), ones("bins")).cast("double")
    d = -BITS / 2 * F.log(1 - 2 * z / BITS)
    e = F.exp(-4 * d / BITS)
    spread = t * (1 - t) * u * (1 - u / union) + t * t * fill + (BITS / 4 * (1 - e) - d * e) / e / 4 + 0.5
    by_bins = (F.col("filleda") + F.col("filledb") - d) / 2 >= t * u - FAR * F.sqrt(spread)
    return (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & F.when(both_small(), near).otherwise(by_bins)


def apart():
    """How far apart sides a and b look: the share of their samples that differ."""
    return F.when(both_small(), ones("odd") / (F.col("na") + F.col("nb"))).otherwise(ones("bins") / (F.col("filleda") + F.col("filledb")))


def confirm(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b: the pairs of nodes that are similar, on their full sets. held: node and text."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            left, right = [], []
            sizes = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3)))
            for part in slices(batch, sizes, CONFIRM_BYTES):
                # Hubs recur: each different text is cut once.
                both = pa.chunked_array([part.column(2), part.column(3)]).combine_chunks().dictionary_encode()
                sets, at = exact_sets([x.as_py().encode() for x in both.dictionary], WORDS), both.indices.to_numpy()
                for a, b, x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), at[: part.num_rows], at[part.num_rows :]):
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * shared >= PERCENT * (len(sets[x]) + len(sets[y]) - shared):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    with_a = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(held.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) of all nodes that have an edge. Alternates large-star and small-star steps;
    a step sends each node's neighbours to the least of them, so stars stay stars and chains halve. Repeated links and links of a node to itself count for nothing (a node that has
    only such ones has no row); links of null nodes are none; no links give no rows."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", few=True)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = written(small, "edges", few=True)
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if same:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


def grouped(base: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n, component_id and rep_th for every row of base (doc_id long and text); component_id
    and rep_th are the least doc_id and th of the row's component, null where the set is empty or doc_id is null."""
    sk = written(sketches(base), "sketches")
    live = sk.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # Classes of equal sets, each with one document that stands for it. A number written once can't clash, as a hash could.
    rep = live.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"))
    classes = written(rep.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "n", "rep.doc_id", "rep.th"), "classes", few=True)
    reps = live.join(classes.select("node", "doc_id", "th", "k1", "k2"), ["doc_id", "th", "k1", "k2"]).dropDuplicates(["node"])
    buckets = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    multi = written(buckets.join(shared, "bucket"), "shared-buckets")
    nodes = multi.select("node").distinct()
    known = written(reps.select("node", *SKETCH, F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands")).join(nodes, "node", "left_semi"), "candidates")
    wanted = classes.join(nodes, "node", "left_semi").select("node", "doc_id", "th")
    held = written(base.withColumn("th", F.xxhash64("text")).join(wanted, ["doc_id", "th"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    labels = nodes.select("node", F.col("node").alias("comp"))
    for seed in range(HUBS):
        labels = merged(labels, written(confirm(nearest_hubs(multi, labels, known, seed), held), "links"))
    labels = merged(labels, written(confirm(still_apart(multi, labels, known), held), "links"))
    named = classes.select("node", "doc_id", "th").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("rep"))
    of_class = classes.select("node", "k1", "k2", "n").join(named.select("node", "comp"), "node").join(least, "comp")
    of_class = written(of_class.select("k1", "k2", "n", F.col("rep.doc_id").alias("component_id"), F.col("rep.th").alias("rep_th")), "class-components", few=True)
    out = sk.select("doc_id", "th", "n", "k1", "k2").join(of_class, ["k1", "k2", "n"], "left")
    known_id = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return out.select("doc_id", "th", "n", known_id("component_id"), known_id("rep_th"))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (columns doc_id and text; others are dropped).

    Texts that are null, empty or blank have an empty set: they are their own component and kept. So are rows without a
    doc_id (component_id null). Rows of one doc_id are rows of their own that may have different components. Ties for
    the representative don't arise: it is the smallest doc_id. An empty table gives no rows.
    """
    out = grouped(id_and_text(docs))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each group of near duplicates: of the smallest doc_id, then of the smallest text hash, and
    of rows that agree in both any one.

    Decided row by row: of two rows of one doc_id with different texts one may go and the other stay. Rows whose text is
    null, empty or blank, and rows without a doc_id, all stay. All columns ride along; an empty table gives no rows.
    """
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("rep_th"))
    rows = grouped(id_and_text(docs)).filter("component_id IS NOT NULL").groupBy("doc_id", "th").agg(F.bool_or(first).alias("again"), F.count("*").alias("c"))
    i, h, again = spare(docs, "i"), spare(docs, "h"), spare(docs, "again")
    # Rows that go, and rows that stay once: the others aren't named.
    marks = written(rows.filter(~F.col("again") | (F.col("c") > 1)).select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("again").alias(again)), "marks", few=True)
    held = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64(F.coalesce("text", F.lit("")))).join(bounded(marks), [i, h], "left")
    return held.filter(F.col(again).isNull()).unionByName(held.filter(again).dropDuplicates([i, h])).select(*docs.columns)


def nearest_hubs(multi: DataFrame, labels: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """a, b: each node with the nearest, by odd sketch, of the hubs of its buckets that are still apart from it."""
    hub = multi.groupBy("bucket").agg(F.min_by("node", F.xxhash64(F.lit(seed), "bucket", "node")).alias("hub"))
    pairs = multi.select("bucket", "node").join(hub, "bucket").filter("node <> hub").select("node", "hub").distinct()
    pairs = pairs.join(labels, "node").join(labels.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub").filter("comp <> hub_comp").select("node", "hub")
    both = pairs.join(known.select("node", *of("a")), "node").join(known.select(F.col("node").alias("hub"), *of("b")), "hub").filter(likely())
    best = both.groupBy("node").agg(F.min_by("hub", F.struct(apart(), "hub")).alias("hub"))
    return best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def still_apart(multi: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: all likely pairs of nodes that share a bucket and not a component. Of two nodes of a bucket at least one is
    outside its largest component; sizes and sketches are compared within the join, and a pair leaves it in the first
    band that it shares.

    Similar sets differ in size by a quarter at most, so nodes lie in size classes each a third wider than the one before,
    and those outside meet their own class and its neighbours. Where these pairs are too many for a key, the nodes outside
    are dealt to several."""
    tagged = multi.join(labels, "node")
    sizes = tagged.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k"), F.sum("c").alias("m")).filter("k > 1")
    # The keys of a bucket, by the most pairs that it can make.
    keys = F.ceil((F.col("m") - F.col("top.c")) * F.col("m") / F.lit(KEY_PAIRS)).cast("int")
    largest = largest.select("bucket", F.col("top.comp").alias("top"), keys.alias("keys"))
    grade = F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int")
    open_ = tagged.join(largest, "bucket").join(known, "node").withColumn("minor", F.col("comp") != F.col("top")).withColumn("grade", grade)
    near = F.explode(F.array(*[F.col("grade") + d for d in (-1, 0, 1)])).alias("grade")
    mine = open_.filter("minor").select("bucket", near, F.pmod(F.xxhash64("node", "bucket"), F.col("keys")).cast("int").alias("key"), "band", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("bands").alias("ba"), *of("a"))
    rest = open_.select("bucket", "grade", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("bands").alias("bb"), "minor", *of("b"))
    once = ~F.col("minor") | (F.col("a") < F.col("b"))
    first = ~F.exists(F.zip_with(F.slice("ba", F.lit(1), F.col("band")), F.slice("bb", F.lit(1), F.col("band")), lambda x, y: x == y), lambda same: same)
    same = [mine[c] == rest[c] for c in ("bucket", "grade", "key")]
    found = mine.join(rest, same[0] & same[1] & same[2] & (F.col("ca") != F.col("cb")) & once & likely() & first)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels with the components that links join made one: the links are reduced to pairs of components first."""
    end = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias("c" + x))
    edges = links.join(end("a"), "a").join(end("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    new = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return written(labels.join(new, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels", few=True)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
