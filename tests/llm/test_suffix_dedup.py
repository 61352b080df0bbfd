"""Suffix dedup against a dictionary of windows."""

import random

import pytest

from loam.llm import suffix_dedup


def plain(rows, size):
    """rows: (doc_id, text) in order. (bytes, removed, stretches, kept) of each row."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - size + 1):
            if raw[p : p + size] in seen:
                gone[p : p + size] = [True] * size
            seen.add(raw[p : p + size])
        begins = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), begins, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def check(spark, rows, size, parts):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = suffix_dedup.deduplicated(docs, size).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key)
    want = sorted(((r[0], *w) for r, w in zip(rows, plain(rows, size))), key=key)
    assert have == want


@pytest.mark.parametrize("size", [16, 21, 40, 100])
def test_random_texts(spark, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1500)
    rng = random.Random(size)
    alphabet = "abé" if size < 40 else "abcdefgh éß"
    pool = ["".join(rng.choices(alphabet, k=rng.randrange(size // 2, 4 * size))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices(alphabet, k=rng.randrange(2 * size))) for _ in range(rng.randrange(8)))) for i in range(80)]
    rows += [(90, "a" * (5 * size)), (91, "a" * size), (92, "ab" * size), (93, None), (94, "x" * (size - 1))]
    check(spark, rows, size, 3)


def test_hot_span_and_its_borders(spark, monkeypatch):
    """A passage within many different texts, exact copies, and copies with one byte changed."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 4000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    line = " ".join(word() for _ in range(25))
    base = " ".join(word() for _ in range(80))
    rows = [(i, f"{word()} {word()} {line} {word()}") for i in range(60)] + [(100 + i, base) for i in range(20)]
    rows += [(200 + i, base[: 9 * i] + "#" + base[9 * i + 1 :]) for i in range(40)]
    check(spark, rows, 100, 5)


def test_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdef", k=20000))
    rows = [(None, long), (1, long[:300]), (2, None), (3, ""), (4, long[5000:5120] + "!"), (5, long + long)]
    check(spark, rows, 100, 2)
    docs = spark.createDataFrame([(1, long, "x")] * 3, "doc_id long, text string, kept string")
    out = suffix_dedup.deduplicated(docs).collect()
    assert sorted(r.n_removed for r in out) == [0, 20000, 20000]
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, long, 1, 2, 3, 4, 5)], "doc_id long, text string, slice int, at int, side int, rows int, n int")
    assert [(r.slice, r.side, r.rows, r.n_removed) for r in suffix_dedup.deduplicated(clash).collect()] == [(1, 3, 4, 0)]


@pytest.mark.parametrize("step", [64, 1000, 1 << 16])
@pytest.mark.parametrize("size", [16, 50, 100])
def test_spans_hold_every_window_once(monkeypatch, size, step):
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rng = random.Random(size)
    texts = ["".join(rng.choices("ab", k=rng.randrange(4 * size))).encode() for _ in range(60)] + [b"", b"a" * 3000, b"ab" * 900]
    raw, ends, total = b"".join(texts), [], 0
    for t in texts:
        ends.append(total := total + len(t))
    held, grams = [], {}
    for at, n, g, k in zip(*(x.tolist() for x in suffix_dedup.spans(raw, ends, size))):
        held += range(at, at + n)
        for p in range(at, at + n):
            assert grams.setdefault(raw[p : p + size], g) == g
    assert held == [p for a, b in zip([0, *ends], ends) for p in range(a, b - size + 1)]
