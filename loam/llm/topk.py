"""Exact top-k inner products, block at a time.

Vectors are stored in blocks, ranges of vec_id, each with its forward index (the matrix of its vectors) and, for every
dimension, the largest and smallest component: the term maxima. For a query the sum over dimensions of the larger of
q * most and q * least bounds every score in a block. Bounds come first, and from the term maxima alone:

1. Each query's most promising block is scored; its k-th best score there is a floor for the query.
2. Only blocks whose bound reaches the floor of some query of a query block are sent to that query block.
3. There each query takes its blocks from the highest bound down, scores whole blocks by a matrix product and stops once
   the next bound is under its k-th score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.shared import table, written

K = 5
EVERY = 50
SCALE = 256
#: Vectors of a data block, queries of a query block: some 1 MB each at 64 dimensions.
BLOCK, QUERIES = 2048, 2048
#: Data blocks that a task scores, and summaries of blocks whose bounds it computes: some 32 MB and 16 MB at 64 dimensions.
RUN, SUMMARIES = 32, 1 << 14
#: Sums below this are exact in double precision.
EXACT = 2.0**53


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: components floor(scale * x) as doubles. Rows go that are null, empty, of null vec_id or hold null or
    non-finite components, be it after they are scaled."""
    scaled = F.transform("embedding", lambda c: c.cast("double") * scale)
    odd = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() & ~odd
    # Doubles of 2^52 and more are whole numbers, and floor() would make longs of them.
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))
    return vectors.filter(ok).select("vec_id", whole.alias("v"))


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """block, dims, ids, again, matrix, most, least: a row for each run of `size` vectors or fewer in ascending vec_id. block:
    any number, different for each row; again: which vectors are there before under the same vec_id."""
    dealt = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id", "v").select("vec_id", "v")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("again", pa.binary()), ("matrix", pa.binary()), ("most", pa.binary()), ("least", pa.binary())])
        held: dict = {}
        last = None

        def close(dims):
            ids, vs, again = zip(*held.pop(dims))
            m = np.array(vs, np.float64)
            return pa.RecordBatch.from_pylist([{"dims": dims, "ids": np.array(ids, np.int64).tobytes(), "again": np.array(again, bool).tobytes(), "matrix": m.tobytes(), "most": m.max(0).tobytes(), "least": m.min(0).tobytes()}], schema)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy()
                held.setdefault(len(v), []).append((i, v, last is not None and last[0] == i and np.array_equal(last[1], v)))
                last = i, v
                if len(held[len(v)]) >= size:
                    yield close(len(v))
        for dims in list(held):
            yield close(dims)

    blocks = dealt.mapInArrow(run, "dims int, ids binary, again binary, matrix binary, most binary, least binary")
    return written(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), name)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best among all vectors but its own row.

    Ties go to the smaller vec_id; fewer than k candidates give fewer rows. Rows whose vector is null, empty or holds null or
    non-finite components, and rows of null vec_id, take no part; vectors meet only vectors of as many dimensions. A pair
    whose score doesn't fit a long is passed over. Repeated vec_ids are candidates each, and queries each: the own row is one
    of the same vec_id and vector. Empty tables give no rows; other columns are ignored.
    """
    data = packed(integers(vectors, scale), BLOCK, "vectors")
    asked = packed(integers(queries, scale), QUERIES, "queries")
    # Bounds: the stated queries against the summaries of all blocks, a thousandth of their size.
    summaries = data.select("dims", F.floor(F.xxhash64("block") / (2.0**64 / _parts(data, SUMMARIES))).cast("int").alias("run"), "block", "most", "least")
    runs = summaries.select("dims", "run").distinct()
    query = asked.select("dims", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q"))
    left = query.join(runs, "dims")
    right = query.select("dims", "q_block").join(summaries, "dims").select(F.col("q_block").alias("qb"), F.col("run").alias("r"), F.col("dims").alias("ds"), "block", "most", "least")
    over = lambda left, f, schema: left.groupBy("q_block", "run", "dims").cogroup(right.groupBy("qb", "r", "ds")).applyInPandas(f, schema)
    # The most promising block of each query, and the floor that it gives.
    first = over(left, _promising, "q_block long, row int, dims int, bound double, block long")
    first = first.groupBy("q_block", "row", "dims").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    seeds = first.groupBy("q_block", "block", "dims").agg(F.sort_array(F.collect_list("row")).alias("rows")).join(query, ["q_block", "dims"]).join(data.select("block", "ids", "again", "matrix"), "block")
    floors = seeds.select("q_block", "dims", "rows", "q_ids", "q", "ids", "again", "matrix").mapInPandas(lambda it: _floors(it, k), "q_block long, row int, floor long")
    floors = written(floors.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("row", "floor"))).alias("floors")), "floors")
    # A query block without any floor has no row there, and all blocks to search.
    query = query.join(floors, "q_block", "left")
    reached = over(left.join(floors, "q_block", "left"), _reached, "q_block long, block long")
    # Survivors, in runs of blocks.
    w = Window.partitionBy("q_block").orderBy("block")
    pairs = reached.withColumn("run", F.floor((F.row_number().over(w) - 1) / RUN).cast("int"))
    pairs = written(pairs, "survivors")
    blocks = pairs.join(data, "block").select(F.col("q_block").alias("qb"), F.col("run").alias("r"), "ids", "again", "matrix", "most", "least")
    asks = pairs.select("q_block", "run").distinct().join(query, "q_block")

    def score(key, q, d):
        import pandas as pd

        out = []
        if len(q) and len(d):
            qids, qm, floors = _query(q)
            out = [(int(key[0]), i, int(qids[i]), n, s) for i, n, s in _scan(qids, qm, d, qm.shape[1], k, floors)]
        return pd.DataFrame(out, columns=["q_block", "row", "query_id", "vec_id", "score"])

    found = asks.groupBy("q_block", "run").cogroup(blocks.groupBy("qb", "r")).applyInPandas(score, "q_block long, row int, query_id long, vec_id long, score long")
    w = Window.partitionBy("q_block", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _parts(data: DataFrame, each: int) -> int:
    return max(1, -(-data.count() // each))


def _query(q):
    """(ids, matrix, floors by row or none) of a query block, the one row of q."""
    ids = np.frombuffer(q["q_ids"][0], np.int64)
    floors = np.full(len(ids), -np.inf)
    if "floors" in q and q["floors"][0] is not None:
        held = dict(q["floors"][0])
        floors[list(held)] = list(held.values())
    return ids, np.frombuffer(q["q"][0], np.float64).reshape(len(ids), -1), floors


def bounds(qm, d):
    """The most that each query can score in each block, rounded up."""
    most, least = (np.frombuffer(b"".join(d[c]), np.float64).reshape(len(d), -1) for c in ("most", "least"))
    with np.errstate(over="ignore", invalid="ignore"):
        slack = np.abs(qm) @ np.maximum(np.abs(most), np.abs(least)).T
        out = np.maximum(qm, 0) @ most.T + np.minimum(qm, 0) @ least.T + slack * (qm.shape[1] * 2.0**-50)
    return np.where(np.isnan(out), np.inf, out)


def _promising(key, q, d):
    import pandas as pd

    if not len(q) or not len(d):
        return pd.DataFrame({"q_block": [], "row": [], "dims": [], "bound": [], "block": []})
    _, qm, _ = _query(q)
    b = bounds(qm, d)
    top = b.argmax(axis=1)
    return pd.DataFrame({"q_block": int(key[0]), "row": np.arange(len(qm), dtype=np.int32), "dims": int(key[2]), "bound": b[np.arange(len(qm)), top], "block": d["block"].to_numpy()[top]})


def products(q, m):
    """(exact inner products of integers held as doubles, as longs; which of them fit a long, or True for all)."""
    most = np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * q.shape[1]
    if most < EXACT:
        return (q @ m.T).astype(np.int64), True
    # Sums of longs whose overflows cancel are right wherever the result fits.
    exact = _longs(q) @ _longs(m).T
    if most < 2.0**62:
        return exact, True
    with np.errstate(over="ignore", invalid="ignore"):
        near = q @ m.T
        slack = np.abs(q) @ np.abs(m).T * (q.shape[1] * 2.0**-50) + 1
        fits = np.abs(near) + slack < 2.0**63
        unsure = ~fits & ~(np.abs(near) - slack > 2.0**63)
    for i, j in zip(*np.nonzero(unsure)):
        fits[i, j] = -(2**63) <= sum(int(a) * int(b) for a, b in zip(q[i], m[j])) < 2**63
    return exact, fits


def _longs(x):
    """Integers held as doubles, modulo 2^64."""
    rest = np.fmod(x, 2.0**64)
    size = np.abs(rest).astype(np.uint64)
    return np.where(rest < 0, np.uint64(0) - size, size).view(np.int64)


def _others(qid, q, ids, again, m):
    """Which vectors are not the query's own row."""
    out = np.ones(len(ids), bool)
    same = np.flatnonzero((ids == qid) & ~again)
    out[same] = (m[same] != q).any(axis=1)
    return out


def _floors(batches, k: int):
    """The k-th best score of queries within one block; queries that find fewer there have no floor."""
    import pandas as pd

    for batch in batches:
        out = []
        for r in batch.itertuples():
            rows, names, again = np.array(r.rows), np.frombuffer(r.ids, np.int64), np.frombuffer(r.again, bool)
            qids, q, m = np.frombuffer(r.q_ids, np.int64)[rows], np.frombuffer(r.q, np.float64).reshape(-1, r.dims)[rows], np.frombuffer(r.matrix, np.float64).reshape(len(names), -1)
            scores, fits = products(q, m)
            fits = np.broadcast_to(fits, scores.shape)
            for i, (row, own, s) in enumerate(zip(rows.tolist(), qids, scores)):
                s = s[_others(own, q[i], names, again, m) & fits[i]]
                if len(s) >= k:
                    out.append((r.q_block, row, int(np.partition(s, len(s) - k)[len(s) - k])))
        yield pd.DataFrame(out, columns=["q_block", "row", "floor"]).astype({"q_block": "int64", "row": "int32", "floor": "int64"})


def _reached(key, q, d):
    import pandas as pd

    if not len(q) or not len(d):
        return pd.DataFrame({"q_block": [], "block": []})
    _, qm, floors = _query(q)
    return pd.DataFrame({"q_block": int(key[0]), "block": d["block"].to_numpy()[(bounds(qm, d) >= floors[:, None]).any(axis=0)]})


def _scan(qids, qm, d, dims: int, k: int, floors) -> list[tuple]:
    blocks = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.again, bool), np.frombuffer(r.matrix, np.float64).reshape(-1, dims)) for r in d.itertuples()]
    bound = bounds(qm, d)
    order = np.argsort(-bound, axis=1, kind="stable")
    best: list[list] = [[] for _ in qids]  # (-score, vec_id), the k best so far
    need = np.array(floors, np.float64)  # what a block's bound must reach
    live = np.arange(len(qids))
    for step in range(len(blocks)):
        live = live[bound[live, order[live, step]] >= need[live]]
        if not len(live):
            break
        for b in np.unique(order[live, step]):
            rows = live[order[live, step] == b]
            ids, again, m = blocks[b]
            scores, fits = products(qm[rows], m)
            for i, s, f in zip(rows, scores, np.broadcast_to(fits, scores.shape)):
                own = f & (s >= need[i]) & _others(qids[i], qm[i], ids, again, m)
                s, names = s[own], ids[own]
                # All that tie with the k-th are kept for the order by vec_id.
                some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                if len(some) > 4 * k:
                    some = some[np.lexsort((names[some], -s[some]))[:k]]
                best[i] = sorted(best[i] + [(-int(s[j]), int(names[j])) for j in some])[:k]
                if len(best[i]) == k:
                    need[i] = max(need[i], -best[i][-1][0])
    return [(i, n, -s) for i, found in enumerate(best) for s, n in found]


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
