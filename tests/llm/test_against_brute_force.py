"""Operators against plain versions over sf0.001, and the SQL oracles."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

import plain
from loam.llm import queries

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    from loam.llm.bpe import BYTE_BPE

    t = Tokenizer.from_file(BYTE_BPE)
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in texts.items()}, t


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())


def test_store(spark, ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op1_token_store"](spark, SF).collect()}
    at, want = 0, {}
    for d in sorted(ids[0]):
        x = ids[0][d] + [2]
        want[d] = (at, len(x), crc(x))
        at += len(x)
    assert got == want


def test_store_select(spark, ids):
    from loam.llm import token_store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in token_store.write_store(docs, shard_ids=5000).collect():
        s = token_store.Shard(r.file)
        for i, d in enumerate(s.doc_ids()):
            assert s.doc(i).tolist() == ids[0][d] + [2]


@pytest.mark.parametrize("tokens", [None, 300])
def test_lm(spark, texts, monkeypatch, tokens):
    from loam.llm import ngram_lm

    if tokens:
        # Many shards, level 3 cut within a first word.
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", tokens)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) + ["</s>"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    one, two, three = Counter(), defaultdict(Counter), defaultdict(Counter)
    for d, w in words.items():
        if not held[d]:
            one.update(w)
            for a, b in zip(["<s>", *w], w):
                two[a][b] += 1
            for a, b, c in zip(["<s>", *w], w, w[1:]):
                three[a, b][c] += 1
    n, v, dis = sum(one.values()), len(one), 0.75
    p1 = lambda w: (one[w] + 1) / (n + v + 1)

    def mixed(c, w, lower):
        t = sum(c.values())
        return max(c[w] - dis, 0) / t + dis * len(c) / t * lower if t else lower

    base = score = 0
    for r in queries.QUERIES["op3_lm_scoring"](spark, SF).collect():
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in one for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(p1(x)) for x in w), rel_tol=1e-9)
        x = [None, "<s>", *w]
        want = sum(math.log10(mixed(three.get((x[i - 2], x[i - 1]), Counter()), x[i], mixed(two.get(x[i - 1], Counter()), x[i], p1(x[i])))) for i in range(2, len(x)))
        # Quantisation rounds each of at most three factors down by less than 1/4096.
        assert want - 3 * len(w) / 4096 <= r.score <= want + 1e-6
        base, score = base + r.base_score, score + r.score
    assert score > base


def test_language(spark):
    out = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    assert sum(r.rejected for r in out) / len(out) < 0.03


def test_language_by_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    books = plain.dictionaries((r.text, r.lang) for r in rows if not out(r.doc_id))
    got = {r.doc_id: r for r in queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows) and all(len(x) > 50_000 for x in books.values())
    for r in rows[::3]:
        lang, score, bad = plain.language(r.text, books)
        mine = got[r.doc_id]
        assert (mine.held_out, mine.lang_pred, mine.rejected) == (out(r.doc_id), lang, bad) and math.isclose(mine.score, score, abs_tol=1e-12)


def test_packing(spark, ids):
    from loam.llm import packing

    rows = queries.QUERIES["op5_packing"](spark, SF).collect()
    want = {}
    for d, x in ids[0].items():
        x, a = x + [0], 0
        for k, n in enumerate(packing.cut(len(x), 2048)):
            want[d, k] = (a, n, crc(x[a : a + n]))
            a += n
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_bpe(spark, texts, ids):
    for r in queries.QUERIES["op8_bpe"](spark, SF).collect():
        x = ids[0][r.doc_id]
        decoded = ids[1].decode(x, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_by_small_slices(spark, ids, monkeypatch):
    from loam.llm import bpe

    monkeypatch.setattr(bpe, "SLICE_CHARS", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id: r.n_tokens for r in bpe.encode_decode(docs).collect()} == {d: len(x) for d, x in ids[0].items()}


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    from loam.llm import bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(bpe, "BUCKET_WORDS", 500)
    slices = bpe.split_slices(docs.repartition(5))
    table, bucket_of = {}, {}
    rows = bpe.word_ids(slices).collect()
    for r in rows:
        at = 0
        flat = bpe.unsqueezed(r.ids).tolist()
        for word, n in zip(json.loads(zstandard.decompress(r.words)), bpe.unsqueezed(r.sizes).tolist()):
            assert table.setdefault(word, flat[at : at + n]) == flat[at : at + n] and bucket_of.setdefault(word, r.bucket) == r.bucket
            at += n
    assert len({r.slice for r in rows}) > 1 and len(set(bucket_of.values())) > 8 and len(table) > 1000
    assert all(bpe.word_encoder().word(w) == x for w, x in table.items())


def test_fingerprints(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op9_fingerprints"](spark, SF).collect()}
    for i, d in enumerate(order):
        t, after = texts[d], texts[order[(i + 1) % len(order)]]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        x, y, z = plain.lanes(t), plain.lanes(edited), plain.lanes(after)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), plain.sha(edited))
        assert (r.fingerprint, r.edited_fingerprint) == (plain.fingerprint(*x), plain.fingerprint(*y))
        assert math.isclose(r.near_edited, plain.likeness(x, y)) and math.isclose(r.near_next, plain.likeness(x, z))
    prints = defaultdict(set)
    for d in order:
        prints[texts[d]].add(got[d].fingerprint)
    assert len(set().union(*prints.values())) == len(prints)
    better = [got[d].near_edited > got[d].near_next for d in order if len(texts[d]) > 500]
    assert sum(better) / len(better) > 0.9


def test_fingerprints_add_and_subtract(spark):
    """Pieces put in or taken out, in any order, by the fingerprints alone."""
    from loam.llm import fingerprint

    rng = random.Random(9)
    pieces = [f"piece {i}.\n" for i in range(400)]
    rows = []
    for i in range(60):
        whole = rng.choices(pieces, k=rng.randrange(0, 90))
        cut = rng.randrange(len(whole) + 1)
        mixed = list(whole)
        rng.shuffle(mixed)
        rows.append((i, "".join(whole[:cut]), "".join(whole[cut:]), "".join(mixed)))
    docs = spark.createDataFrame(rows, "doc_id int, a string, b string, ab string")
    prints = {c: fingerprint.fingerprints(docs, c, "doc_id").withColumnRenamed("fingerprint", c) for c in ("a", "b", "ab")}
    both = prints["a"].join(prints["b"], "doc_id").join(prints["ab"], "doc_id")
    out = both.select("*", fingerprint.inserted("a", "b").alias("sum"), fingerprint.deleted("ab", "b").alias("rest")).collect()
    assert len(out) == 60 and all(r["sum"] == r.ab and r.rest == r.a for r in out) and len({r.ab for r in out}) > 50


def test_fingerprint_is_a_sum(spark):
    from loam.llm import fingerprint

    rows = [(1, "a one.\nb two.\nc three.\n"), (2, "c three.\na one.\nb two.\n"), (3, "a one.\nb two.\n"), (4, "")]
    out = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id int, text string"), "text", "doc_id").collect()}
    assert out[1] == out[2] != out[3]
    dense = {d: [int(p.split(".")[0][8 * i : 8 * i + 8], 16) for i in range(8)] for d, p in out.items()}
    single = fingerprint.fingerprints(spark.createDataFrame([(1, "c three.\n")], "doc_id int, text string"), "text", "doc_id").first().fingerprint
    part = [int(single[8 * i : 8 * i + 8], 16) for i in range(8)]
    assert dense[1] == [(a + b) % 2**32 for a, b in zip(dense[3], part)] and dense[4] == [0] * 8


def test_line_runs_are_incremental(spark):
    from loam.llm import line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for batches, fanout in ((1, 2), (5, 2), (6, 3)):
        out = line_dedup.dedup_lines(docs, 4, batches, fanout).select("doc_id", "n_dropped")
        want = line_dedup.dedup_lines(docs, 4, 1, 9).select("doc_id", "n_dropped")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_line_runs_go_on(spark):
    from loam.llm import line_dedup

    rows = [(i, f"common\nonly {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = line_dedup.LineRuns(spark, 10, 2)
    for lo in (0, 4):
        first.add(docs.filter(f"doc_id >= {lo} AND doc_id < {lo + 4}"))
    again = line_dedup.LineRuns(spark, 10, 2, first.state())
    assert again.frequent().count() == 0 and again.unseen(docs).count() == 4
    again.add(docs.filter("doc_id >= 8"))
    assert again.frequent().count() == 1 and again.unseen(docs).count() == 0


def test_near_dedup_of_chains_and_crowds(spark):
    """A crowd around a text that is no hub, a chain of near copies, and strangers that share passages."""
    import random

    from loam.llm import near_dedup

    random.seed(3)
    vocab = [f"w{i}" for i in range(5000)]
    base = random.choices(vocab, k=300)
    rows = []

    def edited(words, at, n):
        out = list(words)
        out[at : at + n] = random.choices(vocab, k=n)
        return out

    for i in range(120):
        rows.append(edited(base, random.randrange(260), 28))
    rows.append(base)
    chain = random.choices(vocab, k=200)
    for _ in range(8):
        rows.append(chain)
        chain = edited(chain, random.randrange(180), 16)
    for _ in range(40):
        rows.append(random.choices(vocab, k=150) + base[:100])
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(d).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_topk_prunes_exactly(spark, monkeypatch):
    from loam.llm import topk

    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 8)) * rng.choice([0.1, 3], size=(3000, 1))
    v[::7] = v[0]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for name, n in (("BLOCK", 64), ("RUN", 4), ("QUERIES", 16), ("SUMMARIES", 8)):
        monkeypatch.setattr(topk, name, n)
    got = defaultdict(list)
    for r in topk.search(d, d.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    w = np.floor(256 * v).astype(np.int64)
    for q in range(0, 3000, 50):
        s = w @ w[q]
        best = sorted((int(-x), i) for i, x in enumerate(s) if i != q)[:5]
        assert got[q] == [(i, -x) for x, i in best]


def test_topk_sends_few_blocks(spark, monkeypatch):
    """Vectors whose length grows with their id: only the last blocks can reach a floor."""
    from loam.llm import topk

    rng = np.random.default_rng(2)
    v = np.abs(rng.normal(size=(4096, 8))) * 2 ** (np.arange(4096)[:, None] / 256)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK", 64)
    sent, plain = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: sent.setdefault(name, plain(df, name)))
    rows = topk.search(d, d.filter("vec_id % 50 = 0")).collect()
    blocks, survivors = sent["vectors"].count(), sent["survivors"].count()
    assert blocks >= 64 and 0 < survivors < blocks / 2
    w = np.floor(256 * v).astype(np.int64)
    assert {(r.query_id, r.rank): r.score for r in rows} == {(q, i + 1): int(x) for q in range(0, 4096, 50) for i, x in enumerate(np.sort(np.delete(w @ w[q], q))[::-1][:5])}


def test_pipeline(spark, ids):
    """Each stage against a plain version, on what its predecessor kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, columns = docs.collect(), docs.columns
    named = dict(p.STAGES)
    assert list(named) == ["language_id", "line_dedup", "near_dedup", "packing"]

    def after(name, held):
        out = named[name](spark, held, SF)
        assert out.columns == columns
        return out.cache(), {r.doc_id: r for r in out.collect()}

    books = plain.dictionaries((r.text, r.lang) for r in rows)
    said = {r.doc_id: plain.language(r.text, books) for r in rows}
    kept, got = after("language_id", docs)
    assert {d: r.lang for d, r in got.items()} == {d: lang for d, (lang, _, bad) in said.items() if not bad}
    order = sorted(got)
    want = dict(zip(order, plain.without_lines([got[d].text or "" for d in order])))
    kept, got = after("line_dedup", kept)
    assert {d: (r.text, r.n_chars) for d, r in got.items()} == {d: (t, len(t)) for d, t in want.items()}
    first = plain.groups([want[d] for d in order])
    kept, got = after("near_dedup", kept)
    assert sorted(got) == [d for i, d in enumerate(order) if first[i] == i] and len(got) < len(order)
    packed = named["packing"](spark, kept, SF).collect()
    x = {d: [*ids[1].encode(r.text, add_special_tokens=False).ids, 0] for d, r in got.items()}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == sorted((d, a, n, crc(t[a : a + n])) for d, t in x.items() for a, n in placed(len(t)))
    run = p.run(spark, SF)
    assert sorted(map(tuple, run.drop("sequence_id", "offset").collect())) == sorted(tuple(r[:5]) for r in packed)


def placed(n):
    first = n % 2048 or 2048
    return [(0, first)] + [(a, 2048) for a in range(first, n, 2048)]


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty texts, repeated rows and doc_ids, extra columns, an empty table, a table in which nothing can be learned."""
    import corpus_pipeline as p

    text = "the water of the gate is the water of the house and the door of the house"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (4, text, "en", "b"), (4, "eine andere Zeile mit ganz anderen Wörtern und noch mehr davon", "de", "b"), (None, text, "en", None), (7, None, None, None), (8, "", "en", "c"), (9, "12 34", "en", "c")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, r1 string, gone int")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.lang) for r in kept.collect()), key=str) == [(1, "en"), (4, "de"), (None, "en")]
    assert p.STAGES[-1][1](spark, kept, SF).count() == 3 and p.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    assert p.STAGES[0][1](spark, docs.withColumn("lang", docs.lang.substr(1, 0)).filter("lang IS NULL"), SF).count() == 0
