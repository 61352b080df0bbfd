"""Near duplicates by words, not hashes; by row, not by doc_id; and with buckets dealt to several keys."""

import random

import pytest

from loam.llm import near_dedup, words


def thue_morse(n, flip):
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    long = [thue_morse(2048, 0), thue_morse(2048, 1), thue_morse(1024, 0), thue_morse(1024, 1)]
    out = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(i, i, True) for i in range(4)]


def test_lanes_tell_words_apart():
    known = [w for n in range(1, 18) for w in ("a" * n, "a" * (n - 1) + "b", "b" + "a" * (n - 1), "a" * (n - 1) + "\0", "\0" * n)]
    known = list(dict.fromkeys(known))
    (x, y), n = words.word_lanes([" ".join(known).encode()])
    assert n.tolist() == [len(known)] and len(set(x.tolist())) == len(set(y.tolist())) == len(known)
    (u, _), n = words.word_lanes([b"", " É\tA\x0bb\x1cc ".encode(), b" \n", b"a"])
    assert n.tolist() == [0, 3, 0, 1] and u[1] == u[3] != u[0]


def test_exact_sets():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c Dd dd".split(), k=rng.randrange(14))).encode() for _ in range(80)]

    def true(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, hashed = words.exact_sets(texts), words.shingles(texts)
    at = [0, *hashed[1].cumsum()]
    for i, a in enumerate(texts):
        assert len(sets[i]) == len(true(a)) == len(set(map(tuple, hashed[0][at[i] : at[i + 1]].tolist())))
        assert all(len(set(sets[i]) & set(sets[j])) == len(true(a) & true(texts[j])) for j in range(i))


COPY = "one two three four five six seven eight"


def test_rows_stay_or_go_one_by_one(spark):
    rows = [(1, COPY, "a"), (4, COPY, "b"), (4, "another text of its own with quite other words", "c"), (1, COPY, "d"), (9, COPY.upper(), "e"), (None, COPY, "f"), (None, COPY, "g"), (5, "", "h"), (5, "", "i"), (6, None, "j"), (1, "short", "k"), (2, "Short", "l")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, i int, h int").repartition(3)
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(r.lang for r in out.collect())
    assert got in (sorted(x + "cfghijk") for x in "ad")
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [8, 1 << 22])
def test_no_link_is_lost_however_buckets_are_dealt(spark, monkeypatch, pairs):
    """Texts that share passages in all degrees, half of them of other sizes, against all pairs."""
    monkeypatch.setattr(near_dedup, "KEY_PAIRS", pairs)
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    base = rng.choices(vocab, k=160)
    rows = [base[: rng.randrange(90, 160)] + rng.choices(vocab, k=rng.randrange(60)) for _ in range(90)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    comp = list(range(len(rows)))
    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert links > 100 and len(set(comp)) > 10
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == dict(enumerate(comp))
