"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 is the vocabulary: sorted word hashes, whose ranks are the word ids, with counts. Level 2 holds, for every context
word, the words seen after it; level 3, for every pair of level 2, the words seen after that pair, each as its position
among the successors of the pair's second word (context-relative, so the numbers are small). In levels 2 and 3 a node is
the sum of its parent's base and its own number, which makes the level one monotone sequence: Elias-Fano coded, and
searched by successor. Pointers and bases are Elias-Fano coded too. Next to the nodes lie their smoothed log
probabilities and their backoff weights, quantised to 16 bits. Each level is cut into shards, files that are memory-mapped
by the tasks that read them: level 2 by ranges of the first word (a word has no more successors than there are words),
level 3 by ranges of pairs, cut so that the pairs of a shard occur about equally often, whatever word they begin with.

Counts are gathered as sorted runs: a task merges the n-grams of its texts, and sends each shard its part as one
compressed run of key differences and counts.

Smoothing: interpolated absolute discounting, p(w|h) = max(c(hw) - D, 0) / c(h) + D * t(h) / c(h) * p(w|h'), t(h) being
the number of different words after h; below that the add-one unigram model, which keeps one place for unknown words.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.elias_fano import EliasFano, encode
from loam.llm.shared import crc_mod, mapped, put_bytes, scratch, table, written
from loam.llm.words import mix, steps, word_hashes

HELD_OUT = (7, 2)
DISCOUNT = 0.75
ORDER = 3
#: 16-bit quantisation: units of 1/4096 of a decimal digit, always rounded down to the less probable.
UNIT = 4096
#: Tokens whose n-grams a shard holds, shards at least, and n-grams that a task holds before it sends them off.
SHARD_TOKENS, SHARDS, HELD = 1 << 22, 24, 1 << 21
#: Bytes of texts whose n-grams are looked up together.
STEP = 1 << 22
END = int(mix(np.array([0xE0D], np.uint64))[0])


def quantised(log_p):
    return np.minimum(np.ceil(np.maximum(-log_p, 0) * UNIT), 65535).astype(np.uint16)


def tokens(raw: list[bytes]):
    """(hashes of all words and of an end for each text, how many of both each text has)."""
    h, n = word_hashes(raw)
    ends = np.cumsum(n)
    return np.insert(h, ends, np.uint64(END)), n + 1


def merged(keys, counts):
    """Sorted different keys with their counts added."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


# Level 1 -------------------------------------------------------------------------------------------------------------


def count_words(train: DataFrame) -> DataFrame:
    """h, c: word hashes (as signed longs) and counts. train: text."""

    def run(batches):
        import pyarrow as pa

        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, raw in steps(batch.column(0)):
                k, c = np.unique(tokens(raw)[0], return_counts=True)
                keys, counts = merged(np.concatenate([keys, k]), np.concatenate([counts, c]))
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def write_words(counts: DataFrame, path: str, bits: int) -> list[tuple]:
    """(shard, file, words) of the vocabulary's shards: one for each value of the upper bits of the hash."""

    def write(key, pdf):
        import pandas as pd

        h, c = merged(pdf["h"].to_numpy().astype(np.int64).view(np.uint64), pdf["c"].to_numpy().astype(np.int64))
        uri = put_bytes(f"{path}/level1/{int(key[0]):06d}", (struct.pack("<Q", len(h)), h.tobytes(), c.tobytes()))
        return pd.DataFrame({"shard": [int(key[0])], "file": [uri], "n": [len(h)]})

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    rows = counts.withColumn("shard", shard).groupBy("shard").applyInPandas(write, "shard int, file string, n long").collect()  # a row a shard
    return sorted((r.shard, r.file, r.n) for r in rows)


class Words:
    def __init__(self, manifest: list[tuple], bits: int):
        self.bits, self.parts, at = bits, {}, 0
        for shard, uri, n in manifest:
            raw = mapped(uri)
            self.parts[shard] = (at, np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n))
            at += n
        self.size = at

    def look_up(self, h):
        """(ids, counts) of hashes; id -1 and count 0 where unknown."""
        u, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        shard = (u >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(u), np.int64)
        for s in np.unique(shard):
            if s not in self.parts:
                continue
            at, keys, c = self.parts[s]
            i, j = np.searchsorted(shard, (s, s + 1))
            p = np.minimum(np.searchsorted(keys, u[i:j]), len(keys) - 1)
            hit = keys[p] == u[i:j]
            ids[i:j] = np.where(hit, at + p, -1)
            counts[i:j] = np.where(hit, c[p], 0)
        return ids[back], counts[back]

    def counts_of(self, ids):
        """Counts by id."""
        out = np.zeros(len(ids), np.int64)
        for at, keys, c in self.parts.values():
            own = (ids >= at) & (ids < at + len(keys))
            out[own] = c[ids[own] - at]
        return out


# Levels 2 and 3 ------------------------------------------------------------------------------------------------------


def packed_run(keys, counts) -> tuple[bytes, bytes]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    d = np.diff(keys, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8)
    # Bytes of equal significance lie together; they compress better.
    return z.compress(np.ascontiguousarray(d.T).tobytes()), z.compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked_run(keys: bytes, counts: bytes):
    import zstandard

    z = zstandard.ZstdDecompressor()
    k = np.ascontiguousarray(np.frombuffer(z.decompress(keys), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    c = np.ascontiguousarray(np.frombuffer(z.decompress(counts), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return np.cumsum(k), c


def level_bytes(parents: int, parent, number, log_p, backoff) -> list[bytes]:
    """A shard of a level: for nodes sorted by (parent, number) pointers, bases, nodes, probabilities; backoff a parent."""
    n = np.bincount(parent, minlength=parents)
    pointers = np.concatenate([[0], np.cumsum(n)])
    reach = np.zeros(parents, np.int64)
    last = pointers[1:][n > 0] - 1
    reach[n > 0] = number[last] + 1
    bases = np.concatenate([[0], np.cumsum(reach)])
    parts = [encode(pointers), encode(bases), encode(bases[parent] + number, int(bases[-1]) + 1), quantised(log_p).tobytes(), quantised(backoff).tobytes()]
    return [struct.pack("<2Q", parents, len(number)), *parts]


class Level:
    """One shard."""

    def __init__(self, uri: str):
        raw = mapped(uri)
        self.parents, self.n = struct.unpack_from("<2Q", raw)
        self.pointers = EliasFano(raw, 16)
        at = 16 + self.pointers.size
        self.bases = EliasFano(raw, at)
        at += self.bases.size
        self.nodes = EliasFano(raw, at)
        at += self.nodes.size
        self.q = np.frombuffer(raw, np.uint16, self.n, at)
        self.back = np.frombuffer(raw, np.uint16, self.parents, at + 2 * self.n)

    def find(self, parent, number, relative: bool):
        """(positions of the nodes in the shard or -1, backoffs of the parents, positions of the nodes among their parent's
        if they are wanted), for parents in ascending order: each parent is looked up once."""
        new = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        own, times = parent[new], np.diff(new, append=len(parent))
        first, end = self.bases.get_two(own)
        x = np.repeat(first, times) + number.astype(np.uint64)
        # A number beyond the parent's last would be found under the next parent.
        upto = (np.repeat(end, times) - x).view(np.int64)
        inside = np.flatnonzero(upto > (0 if relative else 1))
        i = np.full(len(x), -1, np.int64)
        i[inside] = self.nodes.find(x[inside])
        if not relative:
            # The parent's last number itself stands before the next parent's nodes.
            last = np.flatnonzero(upto == 1)
            i[last] = self.pointers.get(parent[last] + 1).astype(np.int64) - 1
        return i, np.repeat(self.back[own], times), i - np.repeat(self.pointers.get(own).astype(np.int64), times) if relative else None


class Trie:
    """The vocabulary and the shards of levels 2 and 3. meta is what build() returns, all of it small."""

    def __init__(self, meta: dict):
        self.words = Words(meta["words"], meta["bits"])
        self.n, self.v, self.width = meta["n"], meta["v"], meta["width"]
        self.files2, self.files3 = meta.get("level2", []), meta.get("level3", [])
        self.first2 = np.concatenate([[0], np.cumsum([n for _, _, n in self.files2])]).astype(np.int64)
        self.edges3 = np.array(meta.get("edges3", [0]), np.int64)
        self.level2 = [Level(f) for _, f, _ in self.files2]
        self.level3 = [Level(f) for _, f, _ in self.files3]

    def unigram(self, counts):
        return np.log10((counts + 1) / (self.n + self.v + 1))

    def _nodes(self, parent, number, levels, edges):
        """(shard's first node + position or -1, position among the parent's nodes, quantised -log p, quantised -log backoff
        of the parent) of each parent and number, -1 and 0 for parents below 0. edges: the first parent of each shard and
        the end. Equal queries are answered once, in ascending order, so that neighbours share what they read."""
        wide = np.int64(self.v + 1)
        # The start's id is never predicted: it stands for numbers that are unknown.
        keys = parent * wide + np.where(number < 0, self.v, number)
        known = parent >= 0
        some = not known.all()
        keys, back_to = np.unique(keys[known] if some else keys, return_inverse=True)
        p = keys // wide
        x = keys - p * wide
        at, r = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        q, bo = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint16)
        cuts = np.searchsorted(p, edges)
        for s, level in enumerate(levels):
            i, j = cuts[s], cuts[s + 1]
            if i == j:
                continue
            found, bo[i:j], rel = level.find(p[i:j] - edges[s], x[i:j], levels is self.level2)
            hit = np.flatnonzero(found >= 0)
            at[i + hit] = found[hit] + (self.first2[s] if levels is self.level2 else 0)
            if rel is not None:
                r[i + hit] = rel[hit]
            q[i + hit] = level.q[found[hit]]

        def spread(values, none):
            if not some:
                return values[back_to]
            out = np.full(len(parent), none, values.dtype)
            out[known] = values[back_to]
            return out

        return spread(at, -1), spread(r, -1) if levels is self.level2 else None, spread(q, 0), spread(bo, 0)

    def bigrams(self, u, w):
        """(node, position among u's successors, quantised -log p, quantised -log backoff of u). u or w below 0 is unknown."""
        return self._nodes(u, w, self.level2, np.minimum(np.arange(len(self.level2) + 1) * self.width, self.v + 1))

    def trigrams(self, node, rel):
        """(whether found, log p, log backoff of the pair). node: of the first two words; rel: of the third after the second."""
        found, _, q, back = self._nodes(node, rel, self.level3, self.edges3)
        return found >= 0, q / -UNIT, back / -UNIT

    @staticmethod
    def _by_shard(shard, levels):
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(len(levels) + 1))
        for s, level in enumerate(levels):
            rows = order[edges[s] : edges[s + 1]]
            if len(rows):
                yield s, level, rows

    def positions(self, raw: list[bytes]):
        """(ids, counts, the id before each or the start's, whether two precede, tokens a text) of texts' tokens."""
        h, n = tokens(raw)
        ids, counts = self.words.look_up(h)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        before = np.concatenate([[0], ids[:-1]])
        before[starts] = self.v  # the start of a text, an id of its own
        return ids, counts, before, starts, n

    def pairs(self, raw: list[bytes]):
        """positions, and each token as a bigram, and the node of the bigram before it (-1 at the start)."""
        ids, counts, before, starts, n = self.positions(raw)
        node, rel, q, back = self.bigrams(before, ids)
        earlier = np.concatenate([[-1], node[:-1]])
        earlier[starts] = -1
        return ids, counts, n, starts, node, rel, q, back, earlier

    def score(self, raw: list[bytes]):
        """For each text: tokens, known ones, base score, score."""
        _, counts, n, starts, _, rel, q2, back2, earlier = self.pairs(raw)
        base = self.unigram(counts)
        p = np.where(rel >= 0, q2 / -UNIT, back2 / -UNIT + base)
        if self.level3:
            found, log3, back3 = self.trigrams(earlier, rel)
            p = np.where(found, log3, back3 + p)
        add = lambda x: np.add.reduceat(x, starts)
        return n, add((counts > 0).astype(np.int64)), add(base), add(p)


@lru_cache(maxsize=1)
def _opened(token: str):
    return Trie(_opened.meta)


def opened(shared) -> Trie:
    """One for each Python worker."""
    _opened.meta = shared.value
    return _opened(shared.value["path"] + "/".join(sorted(k for k in shared.value if k.startswith("level"))))


def gathered(train: DataFrame, keys_of, shard_of) -> DataFrame:
    """shard, keys, counts: sorted runs of the n-gram keys of all texts. keys_of: texts -> keys, as an array of longs."""

    def run(batches):
        import pyarrow as pa

        keys, counts, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def flush():
            shard = shard_of(keys)
            cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else [0]
            rows = [(int(shard[i]), *packed_run(keys[i:j], counts[i:j])) for i, j in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "keys", "counts"])

        for batch in batches:
            for _, raw in steps(batch.column(0), STEP):
                fresh.append(keys_of(raw))
                if sum(map(len, fresh)) + len(keys) > HELD:
                    k, c = np.unique(np.concatenate(fresh), return_counts=True)
                    keys, counts = merged(np.concatenate([keys, k]), np.concatenate([counts, c]))
                    fresh = []
                    if len(keys) > HELD:
                        yield flush()
                        keys, counts = keys[:0], counts[:0]
        if fresh:
            k, c = np.unique(np.concatenate(fresh), return_counts=True)
            keys, counts = merged(np.concatenate([keys, k]), np.concatenate([counts, c]))
        yield flush()

    return train.select("text").mapInArrow(run, "shard int, keys binary, counts binary")


def shard_counts(pdf):
    runs = [unpacked_run(k, c) for k, c in zip(pdf["keys"], pdf["counts"])]
    return merged(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))


def smoothed(parents: int, parent, counts, lower, discount: float):
    """(log p of each node, log backoff of each parent); a parent without nodes backs off freely."""
    total = np.bincount(parent, counts, parents)
    kinds = np.bincount(parent, minlength=parents)
    back = np.where(kinds > 0, discount * kinds / np.maximum(total, 1), 1.0)
    p = np.maximum(counts - discount, 0) / total[parent] + back[parent] * lower
    return np.log10(p), np.log10(back)


def build(train: DataFrame, path: str | None = None, order: int = ORDER, discount: float = DISCOUNT) -> dict:
    """Counts all n-grams of train (text; null: empty) up to the order (1 to 3) and writes the trie below path.

    Repeated rows count as often as they stand there; other columns are ignored; of an empty table nothing is learned. Keys
    of n-grams have 64 bits: some 3 * 10^9 different words, or pairs times words of 2^63, are refused with an error."""
    spark = train.sparkSession
    path = path or scratch(spark, "lm")
    counts = written(count_words(train), "word-counts", few=True)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bits = max(4, int(v >> 20).bit_length())
    shards = max(SHARDS, -(-n // SHARD_TOKENS))
    meta = {"path": path, "bits": bits, "n": n, "v": v, "width": max(1, -(-(v + 1) // shards)), "words": write_words(counts, path, bits)}
    if order < 2 or not n:
        return meta
    base, width = v + 1, meta["width"]
    if base * base >= 1 << 63:
        raise ValueError("too many words for 64-bit keys of pairs; build with order=1")
    share = spark.sparkContext.broadcast
    shared = share(meta)

    def bigram_keys(raw):
        ids, _, before, _, _ = opened(shared).positions(raw)
        return before * base + ids

    def write2(key, pdf):
        import pandas as pd

        s, trie = int(key[0]), opened(shared)
        keys, c = shard_counts(pdf)
        u, w = keys // base - s * width, keys % base
        parents = min(width, base - s * width)
        p, back = smoothed(parents, u, c, 10.0 ** trie.unigram(trie.words.counts_of(w)), discount)
        uri = put_bytes(f"{path}/level2/{s:06d}", level_bytes(parents, u, w, p, back))
        # Where the pairs so far have come to another shard's worth of tokens, level 3 is cut.
        worth = (np.cumsum(c) - c) // SHARD_TOKENS
        return pd.DataFrame({"shard": [s], "file": [uri], "n": [len(keys)], "cuts": [np.flatnonzero(np.diff(worth, prepend=-1) > 0).tolist()]})

    runs = gathered(train, bigram_keys, lambda keys: keys // base // width)
    none = np.zeros(0, np.int64)
    rows = {r.shard: r for r in runs.groupBy("shard").applyInPandas(write2, "shard int, file string, n long, cuts array<long>").collect()}  # a row a shard
    level2 = []
    for s in range(-(-base // width)):
        parents = min(width, base - s * width)
        level2.append((s, rows[s].file, rows[s].n) if s in rows else (s, put_bytes(f"{path}/level2/{s:06d}", level_bytes(parents, none, none, none * 1.0, np.zeros(parents))), 0))
    if order < 3:
        return meta | {"level2": level2}
    first2 = np.concatenate([[0], np.cumsum([n for _, _, n in level2])]).astype(np.int64)
    pairs = int(first2[-1])
    edges3 = sorted({int(first2[s]) + c for s, r in rows.items() for c in r.cuts}) + [pairs]
    meta = meta | {"level2": level2, "edges3": edges3}
    if pairs * base >= 1 << 63:
        raise ValueError("too many pairs of words for 64-bit keys; build with order=2")
    shared = share(meta)

    def trigram_keys(raw):
        _, _, _, _, _, rel, _, _, earlier = opened(shared).pairs(raw)
        some = earlier >= 0
        return earlier[some] * base + rel[some]

    edges = np.array(edges3, np.int64)

    def write3(key, pdf):
        import pandas as pd

        s, trie = int(key[0]), opened(shared)
        keys, c = shard_counts(pdf)
        node, rel = keys // base - edges[s], keys % base
        # A shard's pairs are of one shard of level 2.
        t = int(np.searchsorted(first2, edges[s], side="right")) - 1
        parents = int(edges[s + 1] - edges[s])
        # The second word of each pair, whose successors rel counts, and the probability of the third after it.
        own, back_to = np.unique(node, return_inverse=True)
        second = _second(trie.level2[t], own + (edges[s] - first2[t]))[back_to]
        lower = np.zeros(len(node))
        for t, other, rows in trie._by_shard(second // width, trie.level2):
            at = other.pointers.get(second[rows] - t * width).astype(np.int64) + rel[rows]
            lower[rows] = other.q[at] / -UNIT
        p, back = smoothed(parents, node, c, 10.0**lower, discount)
        uri = put_bytes(f"{path}/level3/{s:06d}", level_bytes(parents, node, rel, p, back))
        return pd.DataFrame({"shard": [s], "file": [uri], "n": [len(keys)]})

    runs = gathered(train, trigram_keys, lambda keys: np.searchsorted(edges, keys // base, side="right") - 1)
    rows = {r.shard: r for r in runs.groupBy("shard").applyInPandas(write3, "shard int, file string, n long").collect()}  # a row a shard
    level3 = []
    for s in range(len(edges3) - 1):
        parents = edges3[s + 1] - edges3[s]
        level3.append((s, rows[s].file, rows[s].n) if s in rows else (s, put_bytes(f"{path}/level3/{s:06d}", level_bytes(parents, none, none, none * 1.0, np.zeros(parents))), 0))
    return meta | {"level3": level3}


def _second(level: Level, node):
    """The words of level-2 nodes: the node less its parent's base."""
    value = level.nodes.get(node)
    pointers = level.pointers.all().astype(np.int64)
    parent = np.searchsorted(pointers, node, side="right") - 1
    return (value - level.bases.all()[parent]).astype(np.int64)


def score(docs: DataFrame, meta: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row. Null text: empty, one token, its end. Repeated rows
    get equal scores; an empty table gives no rows; with nothing learned every token has probability 1."""
    shared = docs.sparkSession.sparkContext.broadcast(meta)

    def run(batches):
        import pyarrow as pa

        trie = opened(shared)
        for batch in batches:
            for first, raw in steps(batch.column(1), STEP):
                yield pa.RecordBatch.from_arrays([batch.slice(first, len(raw)).column(0), *(pa.array(x) for x in trie.score(raw))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(HELD_OUT[0]) == HELD_OUT[1]
    meta = build(docs.filter(~held))
    out = score(docs, meta)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(meta["n"]).cast("long").alias("train_tokens"), "base_score", "score")
