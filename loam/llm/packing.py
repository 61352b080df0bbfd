"""Best-fit packing by the configuration linear program.

Documents are cut into pieces of at most `capacity` ids; only the histogram of piece lengths (at most `capacity` numbers)
comes to the driver. A configuration is a multiset of lengths that fits a sequence. The program "fewest sequences, each
length covered" is solved by multiplicative weights: every length has a weight that falls as it gets covered, a knapsack
by dynamic programming prices the heaviest configuration, and that one is used for a step that covers a fixed share of
its scarcest length. The weights are a solution of the dual, too, once they are divided by the price: each round so proves
a number of sequences that no packing goes below, and passes end when the packing is near the best such bound. Rounded
down, the solution leaves a remainder of at most one sequence for each configuration, which best-fit decreasing packs,
again on the histogram. Pieces get their places by their rank among those of their length.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.bpe import BYTE_BPE, word_encoder
from loam.llm.shared import table, texts, written

CAPACITY = 2048
#: Share of a configuration's scarcest length that one step covers.
STEP = 0.5
#: A round steps along all configurations whose weight is so near that of the heaviest.
SLACK = 0.01
#: More passes follow, with the lengths that ended in roomy sequences weighing more, while sequences exceed the proven bound
#: by more than this share.
GAP, PASSES = 0.001, 12
#: Rounds at most; what they leave uncovered is packed by best-fit.
ROUNDS = 300
#: Rounds for a better bound, where the passes' bound leaves a gap.
DUAL = 200


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over descending lengths: the most weight that fits each room, and the length taken first there
    (an index; -1: none, -2: as with one less room). Of equal gains the longest piece is taken."""
    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = len(lengths) - np.searchsorted(lengths[::-1], np.arange(capacity + 1), side="right")
    for c in range(int(lengths[-1]), capacity + 1):
        k = int(fits[c])
        gain = best[c - lengths[k:]] + weights[k:]
        j = int(gain.argmax())
        best[c], first[c] = best[c - 1], -2
        if gain[j] > best[c - 1]:
            best[c], first[c] = gain[j], k + j
    return best, first


def configuration(anchor: int, room: int, first: np.ndarray, lengths: np.ndarray) -> dict[int, int]:
    """The heaviest configuration that holds the anchor."""
    config = {anchor: 1}
    while room > 0 and first[room] != -1:
        if first[room] == -2:
            room -= 1
            continue
        n = int(lengths[first[room]])
        config[n] = config.get(n, 0) + 1
        room -= n
    return config


def configuration_lp(histogram: dict[int, int], capacity: int = CAPACITY, step: float = STEP, rounds: int = ROUNDS, worth_of: dict[int, float] | None = None) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations and how often (a fraction) each is used, no length more often than it occurs; and the best bound: a
    number that no cover by configurations, whole or in fractions, goes below.

    Each round prices once and steps along every configuration whose weight is within SLACK of the heaviest, the best
    one for each length it may hold. What the rounds leave uncovered is left to the caller. worth_of: factors of the
    lengths' weights.
    """
    left = {n: float(c) for n, c in histogram.items() if c > 0}
    bound, alone = 0.0, 0
    whole = dict(left)
    used: dict[tuple, float] = {}
    # A piece that not even the smallest fits beside has a sequence to itself.
    least = min(left, default=0)
    for n in [n for n in left if n + least > capacity]:
        used[((n, 1),)] = left.pop(n)
        alone += histogram[n]
    for _ in range(rounds):
        left = {n: c for n, c in left.items() if c >= 1}
        if not left:
            break
        lengths = np.array(sorted(left, reverse=True))
        weights = np.array([n / capacity * (worth_of or {}).get(n, 1.0) * math.exp(-(1 - left[n] / whole[n]) / 8) for n in lengths.tolist()])
        best, first = price(weights, lengths, capacity)
        # No configuration weighs more than the price, so every sequence covers at most that much of the whole weight.
        bound = max(bound, sum(w * whole[n] for n, w in zip(lengths.tolist(), weights.tolist())) / best[capacity])
        worth = weights + best[capacity - lengths]
        weight = dict(zip(lengths.tolist(), weights.tolist()))
        stepped = False
        for i in np.argsort(-worth, kind="stable").tolist():
            if worth[i] < (1 - SLACK) * worth.max():
                break
            config = configuration(int(lengths[i]), capacity - int(lengths[i]), first, lengths)
            config = {n: k for n, v in config.items() if (k := min(v, int(left[n]))) > 0}
            # What the knapsack took more often than it is left would make a poorer configuration: wait for a new price.
            if sum(k * weight[n] for n, k in config.items()) < (1 - SLACK) * worth[i]:
                continue
            scarce = min(left[n] / k for n, k in config.items())
            x = scarce if scarce < 4 else step * scarce
            for n, k in config.items():
                left[n] -= k * x
            key = tuple(sorted(config.items(), reverse=True))
            used[key] = used.get(key, 0.0) + x
            stepped = True
        if not stepped:
            break
    return [(dict(k), x) for k, x in used.items()], alone + bound


def proved(histogram: dict[int, int], capacity: int, rounds: int = DUAL) -> float:
    """A number of sequences that no packing goes below: the dual of the program.

    Weights of a known kind come first: for any k, pieces within k of the capacity count whole, those under k nothing and
    the others by their length. Then multiplicative weights: each round prices the weights; the heaviest configurations for each length are taken as a mixture, and a length weighs
    less the more of it, for its count, the mixture takes."""
    lengths = np.array(sorted(histogram, reverse=True))
    count = np.array([histogram[n] for n in lengths.tolist()], float)
    weights = lengths / capacity
    kinds = (np.where(lengths > capacity - k, 1.0, np.where(lengths < k, 0.0, weights)) for k in range(capacity // 2 + 1))
    best_bound = max(float(w @ count) for w in kinds)
    for k in range(rounds):
        best, first = price(weights, lengths, capacity)
        best_bound = max(best_bound, float(weights @ count) / best[capacity])
        worth = weights + best[capacity - lengths]
        taken = np.zeros(len(lengths))
        place = {n: i for i, n in enumerate(lengths.tolist())}
        for i in np.flatnonzero(worth >= (1 - SLACK) * worth.max()).tolist():
            for n, c in configuration(int(lengths[i]), capacity - int(lengths[i]), first, lengths).items():
                taken[place[n]] += c
        share = taken / count
        weights = weights * np.exp(-(share / share.max() - 0.5) / (4 + k / 4))
    return best_bound


def best_fit(histogram: dict[int, int], capacity: int) -> dict[tuple, int]:
    """Best-fit decreasing; how often each configuration is made. Equal sequences are handled together, so the work
    follows the number of different lengths and not of pieces."""
    room: dict[int, dict[tuple, int]] = {}
    order: list[int] = []  # ascending rooms of the open sequences
    for n in sorted(histogram, reverse=True):
        todo = histogram[n]
        while todo:
            i = bisect.bisect_left(order, n)
            if i < len(order):
                r = order[i]
                config, many = room[r].popitem()
                if not room[r]:
                    del room[r], order[i]
                # Best fit goes on in a sequence while another piece fits.
                each = min(r // n, todo)
            else:
                r, config, many, each = capacity, (), todo, min(capacity // n, todo)
            times = min(many, todo // each)
            if times < many and config:
                _open(room, order, r, config, many - times)
            _open(room, order, r - n * each, (*config, (n, each)), times)
            todo -= times * each
    out: dict[tuple, int] = {}
    for many in room.values():
        for config, times in many.items():
            out[config] = out.get(config, 0) + times
    return out


def _open(room: dict, order: list[int], r: int, config: tuple, times: int) -> None:
    if r not in room or not room[r]:
        room[r] = {}
        bisect.insort(order, r)
    room[r][config] = room[r].get(config, 0) + times


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """(configuration, how many sequences) that use every piece exactly once: the best of the passes."""
    return bounded_plan(histogram, capacity)[0]


def bounded_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple, int]], int]:
    """plan(), and the least number of sequences that the passes prove any packing to need."""
    histogram = {n: c for n, c in histogram.items() if c > 0}
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best, worth_of, improved = best_fit(histogram, capacity), dict.fromkeys(histogram, 1.0), False
    for _ in range(PASSES):
        made, bound = _rounded(histogram, capacity, worth_of)
        least = max(least, math.ceil(bound - 1e-6 * (1 + bound)))
        if sum(made.values()) < sum(best.values()):
            best = made
        if sum(best.values()) <= max(least + 1, least * (1 + GAP)):
            break
        if not improved:
            improved, least = True, max(least, math.ceil(proved(histogram, capacity) * (1 - 1e-9)))
        room = dict.fromkeys(histogram, 0.0)
        for config, times in made.items():
            waste = 1 - sum(n * k for n, k in config) / capacity
            for n, k in config:
                room[n] += times * k * waste / histogram[n]
        worth_of = {n: w * (1 + room[n] / 2) for n, w in worth_of.items()}
    return sorted(best.items()), least


def _rounded(histogram: dict[int, int], capacity: int, worth_of: dict[int, float]) -> tuple[dict[tuple, int], float]:
    """A pass: the program's solution rounded down, and best-fit for the rest; and the program's bound."""
    left = dict(histogram)
    made: dict[tuple, int] = {}
    solved, bound = configuration_lp(left, capacity, worth_of=worth_of)
    for config, x in solved:
        times = min([int(x + 1e-9), *(left.get(n, 0) // k for n, k in config.items())])
        if times > 0:
            key = tuple(sorted(config.items(), reverse=True))
            made[key] = made.get(key, 0) + times
            for n, k in config.items():
                left[n] -= k * times
    for key, times in best_fit({n: c for n, c in left.items() if c > 0}, capacity).items():
        made[key] = made.get(key, 0) + times
    return made, bound


def slots(made: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """For each configuration and length a range of ranks: first rank, copies a sequence, first sequence, first offset."""
    rows, sequence, rank = [], 0, {}
    for config, times in made:
        offset = 0
        for n, k in config:
            r = rank.get(n, 0)
            rows.append((n, r, k, sequence, offset))
            rank[n] = r + k * times
            offset += n * k
        sequence += times
    rows.sort()
    return {name: np.array(col, np.int64) for name, col in zip(("length", "rank", "copies", "sequence", "offset"), zip(*rows))} if rows else {name: np.zeros(0, np.int64) for name in ("length", "rank", "copies", "sequence", "offset")}


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the first takes what is over."""
    first = n % capacity or min(n, capacity)
    return [first] + [capacity] * ((n - first) // capacity)


def encoded_pieces(docs: DataFrame, capacity: int, tokenizer_path: str, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, to deal them out, bucket."""

    def run(batches):
        import pyarrow as pa

        encoder, stop = word_encoder(tokenizer_path), int(end).to_bytes(4, "little")
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + stop
                at = 0
                for k, n in enumerate(cut(len(ids) // 4, capacity)):
                    for x, y in zip(out, (doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]))):
                        x.append(y)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()

    import pyarrow as pa

    base = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = pa.int64()
    return base.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str = BYTE_BPE, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Null text counts as empty (the end id alone, one piece); only documents of more than capacity ids are cut, their
    first piece taking the remainder; rows of equal or null doc_id are packed like others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = written(encoded_pieces(docs, capacity, tokenizer_path, end), "pieces")
    # A length may have most of the pieces: they are ranked within a length and bucket, buckets one after the other.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    counts = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths", few=True)
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    where = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(within)).join(starts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("r") - 1).cast("long").alias("rank"))

    def place(batches):
        import pyarrow as pa

        s = where.value
        # Ranges are sorted by length and rank; one search finds both.
        big = np.int64(1) << 44
        edges = s["length"] * big + s["rank"]
        for batch in batches:
            n, rank = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.searchsorted(edges, n * big + rank, side="right") - 1
            over = rank - s["rank"][i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s["sequence"][i] + over // s["copies"][i]), pa.array(s["offset"][i] + over % s["copies"][i] * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
