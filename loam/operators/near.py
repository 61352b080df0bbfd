"""Exact near-duplicate vectors without comparing all of them, and what the greedy rule leaves.

Unit vectors of cosine above t are nearer than sqrt(2 - 2t). Vectors lie in blocks around pivots, in the order of their
distance; a block's summary is its nearest and farthest distance to every pivot, its centre and its radius. By the triangle
inequality summaries alone rule pairs of blocks out, before any vector is sent; the others are compared by matrix products.
On vectors without any structure little is ruled out, and the join is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.sources.scratch import written

#: Vectors of a block; rows of it that are compared at a time; summaries that a task compares with as many.
BLOCK_ROWS, STRIP, SUMMARIES = 2048, 256, 512
#: Neighbouring blocks of a tile: 2 to the power of this.
TILE_BITS = 2
#: Pivots are chosen from a sample of so many vectors (for speed alone: any choice gives the same pairs).
PIVOTS, SAMPLE = 16, 2048


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """i, d, e: chunk_ord, dimensions and unit vector. Vectors go that are null, empty, of length zero or not finite."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = vectors.filter(F.col("embedding").isNotNull()).select(F.col("chunk_ord").cast("long").alias("i"), e.alias("e")).filter(~F.exists("e", lambda x: x.isNull() | F.isnan(x)))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, y: s + y * y))
    v = v.withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return v.select("i", F.size("e").alias("d"), F.transform("e", lambda x: x / F.col("norm")).alias("e"))


def _pivots(v: DataFrame) -> dict:
    """dims -> matrix of pivots: of a bounded sample, each the farthest from those before."""
    held: dict[int, list] = {}
    for r in v.orderBy(F.xxhash64("i"), "i").limit(SAMPLE).collect():
        held.setdefault(r.d, []).append(r.e)
    out = {}
    for d, rows in held.items():
        m = np.array(rows)
        chosen, far = [0], ((m - m[0]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, len(m)) and far.max() > 1e-12:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((m - m[chosen[-1]]) ** 2).sum(1))
        out[d] = m[chosen]
    return out


def blocks(v: DataFrame, block_rows: int) -> DataFrame:
    """block, d, ids, matrix and summary (low, high, centre, radius) of unit_vectors()."""
    pivots = _pivots(v)

    def place(batches):
        for batch in batches:
            dims = batch["d"].to_numpy()
            home, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                if d in pivots:
                    rows = dims == d
                    far = _distances(_matrix(batch["e"].filter(pa.array(rows))), pivots[d])
                    home[rows], dist[rows] = far.argmin(1), far.min(1)
            yield pa.record_batch([batch["i"], batch["d"], batch["e"], pa.array(home), pa.array(dist)], ["i", "d", "e", "home", "dist"])

    def cut(batches):
        held: list = []
        key, room = None, block_rows

        def close():
            m = np.concatenate([x for _, x in held])
            d = m.shape[1]
            far = _distances(m, pivots[d]) if d in pivots else np.zeros((len(m), 1))
            centre = m.mean(0)
            radius = float(np.sqrt(((m - centre) ** 2).sum(1)).max())
            row = {"d": pa.array([d], pa.int32()), "ids": [np.concatenate([x for x, _ in held]).tobytes()], "matrix": [m.tobytes()], "low": [far.min(0).tobytes()], "high": [far.max(0).tobytes()], "centre": [centre.tobytes()], "radius": [radius]}
            held.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            ids, dims, home = (batch[c].to_numpy() for c in ("i", "d", "home"))
            at = 0
            while at < len(ids):
                if held and (key != (dims[at], home[at]) or not room):
                    yield close()
                if not held:
                    key, room = (dims[at], home[at]), block_rows
                same = (dims[at : at + room] == key[0]) & (home[at : at + room] == key[1])
                n = len(same) if same.all() else int(same.argmin())
                held.append((ids[at : at + n], _matrix(batch["e"].slice(at, n))))
                at, room = at + n, room - n
        if held:
            yield close()

    dealt = v.mapInArrow(place, "i long, d int, e array<double>, home int, dist double").repartitionByRange("d", "home", "dist", "i").sortWithinPartitions("d", "home", "dist", "i")
    rows = dealt.mapInArrow(cut, "d int, ids binary, matrix binary, low binary, high binary, centre binary, radius double")
    return written(rows.select(F.monotonically_increasing_id().alias("block"), "*"), "vector-blocks")


def _matrix(vectors):
    """Rows of an Arrow array of vectors of equal dimensions."""
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _distances(m, pivots):
    return np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * m @ pivots.T))


def survivors(held: DataFrame, threshold: float) -> DataFrame:
    """p, q of the block pairs p <= q, of equal dimensions, that may hold a pair of vectors."""
    eps = max(0.0, 2 - 2 * threshold) ** 0.5 + 1e-6
    parts = max(1, -(-held.count() // SUMMARIES))
    s = held.select("block", "d", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("g"), "low", "high", "centre", "radius")
    left = s.select("d", "block", "low", "high", "centre", "radius", F.col("g").alias("x"), F.explode(F.sequence(F.col("g"), F.lit(parts - 1))).alias("y"))
    right = s.select("d", "block", "low", "high", "centre", "radius", F.explode(F.sequence(F.lit(0), F.col("g"))).alias("x2"), F.col("g").alias("y2")).withColumnsRenamed({"d": "d2"})

    def compare(key, a, b):
        if not len(a) or not len(b):
            return pa.table({c: pa.array([], pa.int64()) for c in "pq"})
        of = lambda t, c: np.frombuffer(b"".join(t[c].to_pylist()), np.float64).reshape(len(t), -1)
        near = _distances(of(a, "centre"), of(b, "centre")) - a["radius"].to_numpy()[:, None] - b["radius"].to_numpy() <= eps
        for low_a, high_a, low_b, high_b in zip(of(a, "low").T, of(a, "high").T, of(b, "low").T, of(b, "high").T):
            near &= (low_a[:, None] - high_b <= eps) & (low_b - high_a[:, None] <= eps)
        x, y = np.nonzero(near)
        i, j = a["block"].to_numpy()[x], b["block"].to_numpy()[y]
        keep = i <= j if key[0].as_py() == key[1].as_py() else i != j
        return pa.table({"p": np.minimum(i, j)[keep], "q": np.maximum(i, j)[keep]})

    return left.groupBy("x", "y", "d").cogroup(right.groupBy("x2", "y2", "d2")).applyInArrow(compare, "p long, q long")


def pairs(vectors: DataFrame, threshold: float = 0.97, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b, sim of all pairs a < b of cosine above threshold: what corpus.near_pairs gives.

    Vectors that are null, empty, of length zero or hold null or non-finite components have no pairs; vectors meet only
    those of as many dimensions. Rows of one chunk_ord are no pair; an empty table gives no rows."""
    return scored(*plan(vectors, threshold, block_rows), threshold)


def plan(vectors: DataFrame, threshold: float = 0.97, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(blocks, the pairs of them that are compared)."""
    held = blocks(unit_vectors(vectors), block_rows)
    return held, written(survivors(held, threshold), "block-pairs")


def compared(held: DataFrame, left: DataFrame) -> DataFrame:
    """One row, blocks, all_pairs, compared: how many pairs of blocks there are, and how many are left."""
    n = held.agg(F.count("*").alias("blocks"))
    return n.crossJoin(F.broadcast(left.agg(F.count("*").alias("compared")))).select("blocks", (F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long").alias("all_pairs"), "compared")


def tiles(left: DataFrame) -> DataFrame:
    """x, y, block, ps: the blocks that tasks of two tiles are sent, and for those of the second what each is compared with
    (at most as many as a tile has; null for those of the first)."""
    at = left.select("p", "q", F.shiftright("p", TILE_BITS).alias("x"), F.shiftright("q", TILE_BITS).alias("y"))
    mine = at.select("x", "y", F.col("p").alias("block")).distinct().withColumn("ps", F.lit(None).cast("array<long>"))
    return mine.unionByName(at.groupBy("x", "y", F.col("q").alias("block")).agg(F.collect_list("p").alias("ps")))


def scored(held: DataFrame, left: DataFrame, threshold: float) -> DataFrame:
    rows = tiles(left).join(held.select("block", "ids", "matrix"), "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = {}, []
        for batch in batches:
            for block, ps, ids, matrix in zip(batch["block"].to_pylist(), batch["ps"].to_pylist(), batch["ids"], batch["matrix"]):
                i = np.frombuffer(ids.as_buffer(), np.int64)
                m = np.frombuffer(matrix.as_buffer()).reshape(len(i), -1)
                if ps is None:
                    own[block] = i, m
                else:
                    other.append((block, ps, i, m))
        for q, ps, j, n in other:
            for p in ps:
                yield from _hits(*own[p], j, n, p == q, threshold)

    return rows.groupBy("x", "y").applyInArrow(score, "a long, b long, sim double")


def _hits(i, m, j, n, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a, b, sim, STRIP rows of m at a time: many near copies give many pairs."""
    for first in range(0, len(i), STRIP):
        own = i[first : first + STRIP]
        s = m[first : first + STRIP] @ n.T
        x, y = np.nonzero(s > threshold)
        keep = own[x] < j[y] if same else own[x] != j[y]
        a, b, sim = own[x[keep]], j[y[keep]], s[x[keep], y[keep]]
        if len(a):
            yield pa.record_batch([np.minimum(a, b), np.maximum(a, b), sim], ["a", "b", "sim"])


def gone(links: DataFrame) -> DataFrame:
    """n: the rows that the greedy rule drops, for links (early, late): in order, a row goes if an earlier survivor is linked
    to it.

    In each round rows without an undecided earlier neighbour survive. A row with a single one is its opposite, and that one
    may have a single one again: such chains are followed by doubling, so that rounds don't grow with their length."""
    open_ = written(links.select("early", "late").distinct(), "links")
    out = None
    while not open_.isEmpty():
        alone = open_.select(F.col("early").alias("n")).distinct().join(open_.select(F.col("late").alias("n")), "n", "left_anti")
        single = open_.groupBy(F.col("late").alias("n")).agg(F.min("early").alias("to"), F.count("*").alias("c")).filter("c = 1").select("n", "to", F.lit(True).alias("differs"))
        survives = written(alone.unionByName(_same(single).join(alone.withColumnRenamed("n", "to"), "to", "left_semi").filter("not differs").select("n")), "survivors")
        dropped = written(open_.join(survives.withColumnRenamed("n", "early"), "early", "left_semi").select(F.col("late").alias("n")).distinct(), "dropped")
        out = dropped if out is None else out.unionByName(dropped)
        open_ = written(open_.join(dropped.withColumnRenamed("n", "early"), "early", "left_anti").join(dropped.withColumnRenamed("n", "late"), "late", "left_anti"), "links")
    return out if out is not None else links.select(F.col("early").alias("n")).limit(0)


def _same(single: DataFrame) -> DataFrame:
    """n, to, differs with to followed to the end of its chain."""
    held = written(single, "chains")
    while True:
        on = held.select(F.col("n").alias("to"), F.col("to").alias("further"), F.col("differs").alias("again"))
        step = held.join(on, "to", "left")
        moved = F.col("further").isNotNull()
        held = written(step.select("n", F.coalesce("further", "to").alias("to"), F.when(moved, F.col("differs") != F.col("again")).otherwise(F.col("differs")).alias("differs"), moved.alias("moved")), "chains")
        if held.filter("moved").isEmpty():
            return held.drop("moved")
        held = held.drop("moved")
