"""Repeated byte strings across all texts, by a radix sort of suffixes that goes no deeper than the threshold.

A suffix is ordered by its first `size` bytes only, its window; suffixes whose windows are equal are the repeats. Digits are
taken most significant first, and a suffix leaves as soon as its group holds no other:

1. The first digit is a gram of about half a window: the one of least hash within it, the leftmost of equal ones. Equal
   windows have it at the same place, and neighbouring windows mostly share it: such a stretch of windows is one row, a span.
2. The second digit is all of a span. Of equal spans the first stays, the others are repeats; a span that has its gram for
   itself leaves; different spans of one gram go on.
3. The last digit is the window itself, for each window of the spans that are left.

Documents lie in slices, in doc_id order within each. Slices meet only in grams and windows that each of them has reduced to
one row before, so no key has more rows than there are slices. Groups are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.shared import bounded, mapped, put_bytes, scratch, table, written
from loam.llm.words import MUL, mix

SIZE = 100
#: Bytes of text after which a slice is closed; a longer text is a slice of its own. Positions that are hashed at a time.
SLICE_BYTES, STEP = 1 << 21, 1 << 16
LOW = np.uint64((1 << 18) - 1)
M1, M2 = np.uint64(MUL), np.uint64(0xD6E8FEB86659FD93)
#: What a row says: a span with its keys, a span that goes on in any case, a repeat.
SPAN, OPEN, REPEAT = 0, 1, 2


def eights(raw: bytes):
    """The 8 bytes at each position, as little-endian numbers."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def gram_hashes(eight, size: int):
    """The hash of the `size` (8 or more) bytes at each position."""
    h, n = mix(eight), 8
    while 2 * n <= size:
        h, n = mix(h[:-n] * M1 + h[n:]), 2 * n
    return h if n == size else mix(h[: n - size] * M1 + h[size - n :])


def window_hashes(eight, at, size: int, mul):
    """The hash of the `size` (8 or more) bytes at the positions `at`."""
    h = np.full(len(at), size, np.uint64)
    for step in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        h = mix(h * mul + eight[at + step])
    return h


def spans(raw: bytes, ends, size: int):
    """(first window, number of windows, gram, digit of the whole span) of all spans; ends: where each text ends in raw."""
    gram = max(8, (size - 4) // 16 * 8)
    grams = size - gram + 1
    many = len(raw) - size + 1
    nothing = np.zeros(0, np.int64)
    if many < 1:
        return nothing, nothing, nothing, nothing
    ends = np.asarray(ends, np.int64)
    # Windows that would reach into the next text.
    change = np.zeros(len(raw) + 1, np.int32)
    np.add.at(change, np.maximum(np.concatenate([[0], ends[:-1]]), ends - size + 1), 1)
    np.add.at(change, ends, -1)
    inside = np.cumsum(change)[:many] == 0
    eight, found = eights(raw), []
    for a in range(0, many, STEP):
        b = min(many, a + STEP)
        held = gram_hashes(eight[a : b + size - 8], gram)
        least = (held & ~LOW) | np.arange(len(held), dtype=np.uint64)
        n = 1
        while 2 * n <= grams:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        if n < grams:
            least = np.minimum(least[: n - grams], least[grams - n :])
        anchor, ok = (least & LOW).astype(np.int64), inside[a:b]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])]))
        last = np.concatenate([new[1:], [b - a]])
        keep = ok[new]
        found.append((new[keep] + a, (last - new)[keep], held[anchor[new[keep]]]))
    at, n, g = (np.concatenate(x) for x in zip(*found))
    whole = mix(window_hashes(eight, at, size, M1) * M1 + window_hashes(eight, at + n - 1, size, M2) + n.astype(np.uint64))
    return at, n, g.view(np.int64), whole.view(np.int64)


def merged(start, end):
    """The union of intervals, as (starts, ends); those that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, upto = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > upto[:-1]])
    return start[new], upto[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


class Slice:
    """The rows of a slice, in doc_id order: raw bytes of all texts and where each one ends."""

    def __init__(self, blob):
        import pyarrow as pa

        self.rows = pa.ipc.open_stream(pa.BufferReader(blob)).read_all().combine_chunks()
        texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in self.rows["text"].combine_chunks()]
        self.raw = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)

    def ids(self, at):
        """The doc_id of the text at each position."""
        import pyarrow as pa

        return self.rows["doc_id"].combine_chunks().take(pa.array(np.searchsorted(self.ends, at, "right")))


def slices(docs: DataFrame) -> DataFrame:
    """slice, rows: the documents, all columns, as Arrow streams of some SLICE_BYTES."""

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, size = [], 0

        def close():
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows["doc_id"], null_placement="at_start"))
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["rows"])

        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                before = upto[first - 1] if first else 0
                last = int(np.searchsorted(upto, before + SLICE_BYTES - size, "right"))
                if last > first:
                    held.append(batch.slice(first, last - first))
                    size += int(upto[last - 1] - before)
                if last < batch.num_rows:
                    if not held:
                        held.append(batch.slice(last, 1))
                        last += 1
                    yield close()
                    held, size = [], 0
                first = last
        if held:
            yield close()

    return written(docs.mapInArrow(cut, "rows binary").select(F.monotonically_increasing_id().alias("slice"), "rows"), "slices")


FOUND = "kind int, g long, k long, doc_id long, slice long, at long, n long"


def _rows(s: Slice, name: int, kind: int, at, n, g, k):
    import pyarrow as pa

    many = len(at)
    k = pa.nulls(many, pa.int64()) if k is None else pa.array(k, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(many, kind, np.int32)), pa.array(g, pa.int64()), k, s.ids(at).cast(pa.int64()), pa.array(np.full(many, name, np.int64)), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["kind", "g", "k", "doc_id", "slice", "at", "n"])


def _first_of(a, b, at):
    """(order by a, b and place; in that order, whether a row is the first of its a; of its a and b)."""
    order = np.lexsort((at, b, a))
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[order][1:] != a[order][:-1]
    new_b = new_a.copy()
    new_b[1:] |= b[order][1:] != b[order][:-1]
    return order, new_a, new_b


def _anywhere(name: int, at):
    """Keys that deal rows out which need meet no other."""
    return mix(at.astype(np.uint64) + mix(np.uint64(name & (2**64 - 1)))).view(np.int64)


def _repeats(s: Slice, name: int, at, n, size: int):
    start, end = merged(at, at + n + size - 1)
    return _rows(s, name, REPEAT, start, end - start - size + 1, _anywhere(name, start), None)


def first_digits(sliced: DataFrame, size: int) -> DataFrame:
    """FOUND: the spans of all slices. A span equal to an earlier one of its slice is a repeat; different spans of one gram
    in a slice go on, and one row without k stands for them all where the slices' grams meet."""

    def run(batches):
        for batch in batches:
            for name, blob in zip(batch["slice"].to_pylist(), batch["rows"]):
                s = Slice(blob.as_buffer())
                at, n, g, k = spans(s.raw, s.ends, size)
                if not len(at):
                    continue
                order, new_g, new = _first_of(g, k, at)
                again = order[~new]
                yield _repeats(s, name, at[again], n[again], size)
                order, new_g = order[new], new_g[new]
                group = np.cumsum(new_g) - 1
                alone = np.bincount(group)[group] == 1
                one, more, some = order[alone], order[~alone], order[~alone & new_g]
                yield _rows(s, name, SPAN, at[one], n[one], g[one], k[one])
                yield _rows(s, name, OPEN, at[more], n[more], _anywhere(name, at[more]), None)
                yield _rows(s, name, SPAN, at[some], np.zeros(len(some), np.int64), g[some], None)

    return sliced.mapInArrow(run, FOUND)


def last_digits(sliced: DataFrame, left: DataFrame, size: int) -> DataFrame:
    """FOUND, g and k being the hashes of a window: a row for each different window of the spans that are left in a slice."""

    def run(batches):
        for batch in batches:
            for name, blob, side in zip(batch["slice"].to_pylist(), batch["rows"], batch["side"].to_pylist()):
                s = Slice(blob.as_buffer())
                first, n = np.frombuffer(mapped(side), np.int64).reshape(2, -1)
                at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                eight = eights(s.raw)
                g, k = (window_hashes(eight, at, size, m).view(np.int64) for m in (M1, M2))
                order, _, new = _first_of(g, k, at)
                again = order[~new]
                yield _repeats(s, name, at[again], np.ones(len(again), np.int64), size)
                one = order[new]
                yield _rows(s, name, SPAN, at[one], np.ones(len(one), np.int64), g[one], k[one])

    return with_sides(sliced, left, "inner").mapInArrow(run, FOUND)


def with_sides(sliced: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The slices with the name of a side file each, that holds at and n of the slice's rows: texts needn't be shuffled."""
    folder = scratch(sliced.sparkSession, "sides")

    def put(rows):
        import pandas as pd

        name = int(rows["slice"].iloc[0])
        pair = np.stack([rows["at"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)])
        return pd.DataFrame({"slice": [name], "side": [put_bytes(f"{folder}/{name}", [pair.tobytes()])]})

    names = written(rows.groupBy("slice").applyInPandas(put, "slice long, side string"), "side-names")
    return sliced.join(bounded(names), "slice", how)


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The columns of docs, n_bytes, n_removed, n_spans and kept (binary) for every row of docs.

    Each byte goes that is covered by a string of `size` bytes (16 or more) which also starts earlier: in a smaller doc_id, or
    earlier in the same text; overlaps count, and texts are judged as they came. n_spans is the number of maximal stretches
    that went; kept, what is left, need not be UTF-8. Null text counts as empty; texts shorter than `size` keep all; null
    doc_ids come first; rows that share a doc_id count in the order read, so of repeated rows one stays; columns of docs
    named like those added are replaced; an empty table gives no rows.
    """
    if size < 16:
        raise ValueError("size is 16 or more")
    base = docs.drop("n_bytes", "n_removed", "n_spans", "kept").withColumn("doc_id", F.col("doc_id").cast("long"))
    sliced = slices(base)
    order = ["doc_id", "slice", "at"]
    met = first_digits(sliced, size).repartition("g")
    nth = F.row_number().over(Window.partitionBy("g", "k").orderBy(*order))
    kinds = F.sum((F.col("nth") == 1).cast("int")).over(Window.partitionBy("g"))
    span = F.col("kind") == SPAN
    met = met.withColumn("nth", nth).withColumn("kinds", kinds).filter("n > 0 or kind <> 0").select(
        F.when(span & (F.col("nth") > 1), REPEAT).when(span & (F.col("kinds") > 1), OPEN).otherwise(F.col("kind")).alias("kind"), "slice", "at", "n")
    met = written(met.filter(F.col("kind") != SPAN), "digits")
    nth = F.row_number().over(Window.partitionBy("g", "k").orderBy(*order))
    windows = last_digits(sliced, met.filter(F.col("kind") == OPEN), size).withColumn("nth", nth)
    repeats = windows.filter((F.col("kind") == REPEAT) | (F.col("nth") > 1)).select("slice", "at", "n")
    repeats = repeats.unionByName(met.filter(F.col("kind") == REPEAT).select("slice", "at", "n"))
    added = T.StructType([T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])
    return with_sides(sliced, repeats, "left").mapInArrow(lambda it: _kept(it, size), T.StructType(base.schema.fields + added.fields))


def _kept(batches, size: int):
    import pyarrow as pa

    for batch in batches:
        for blob, side in zip(batch["rows"], batch["side"].to_pylist()):
            s = Slice(blob.as_buffer())
            at, n = np.frombuffer(mapped(side) if side else b"", np.int64).reshape(2, -1)
            start, end = merged(at, at + n + size - 1)
            change = np.zeros(len(s.raw) + 1, np.int8)
            change[start], change[end] = 1, -1
            gone = np.cumsum(change, dtype=np.int8)[:-1].astype(bool)
            first = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
            # A stretch begins where the byte before stays, or belongs to another text.
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            opened = first[first < s.ends]
            begins[opened] = gone[opened]
            upto, stretches = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, begins))
            removed, raw = upto[s.ends] - upto[first], np.frombuffer(s.raw, np.uint8)
            kept = [raw[a:b][~gone[a:b]].tobytes() if r else s.raw[a:b] for a, b, r in zip(first.tolist(), s.ends.tolist(), removed.tolist())]
            more = [pa.array(s.ends - first), pa.array(removed), pa.array(stretches[s.ends] - stretches[first]), pa.array(kept, pa.binary())]
            out = pa.Table.from_arrays([*s.rows.columns, *more], [*s.rows.column_names, "n_bytes", "n_removed", "n_spans", "kept"])
            yield from out.to_batches(max_chunksize=4096)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS pos FROM d),
w AS (SELECT doc_id, pos, md5_number(x[2 * pos + 1 : 2 * pos + 200]) AS win FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM w),
r AS (SELECT doc_id, pos, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1000) > 100 AS new FROM f WHERE again),
g AS (SELECT doc_id, pos, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM r),
i AS (SELECT doc_id, min(pos) AS s, max(pos) + 100 AS e FROM g GROUP BY doc_id, grp),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM i),
a AS (SELECT k.doc_id, string_agg(x[2 * before + 1 : 2 * s], '' ORDER BY s) AS head, max(e) AS tail, sum(e - s) AS removed, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || x[2 * coalesce(tail, 0) + 1 :])) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
