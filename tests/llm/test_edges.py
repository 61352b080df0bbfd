"""Odd input for every operator: nulls in any column, empty and very long texts, repeated rows, empty tables, extra
columns whose names clash with the operators' own."""

import pytest
from pyspark.sql import functions as F

from loam.llm import bpe, chat, fingerprint, langid, line_dedup, near_dedup, ngram_lm, packing, token_store, topk

LONG = "the quick brown fox jumps over it. " * 9000
ROWS = [
    (None, "null id", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, " \n\t\n", "de"),
    (4, "same text of more than five words here", "en"),
    (4, "same text of more than five words here", "en"),
    (5, "same text of more than five words here", "en"),
    (6, LONG, "en"),
    (7, "日本語 テキスト 😀 ꙮ <|endoftext|>", "ja"),
    (8, "12345 67890 !!", "en"),
    (2**40, "x", None),
]
CLASH = "r1 r2 gone place first offset part deal slice sizes words file i row lines hits bucket rn th n node score rank tie key length piece kept lang_pred rejected rendered spans base start h c k1 bands comp q v run block".split()


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, "doc_id long, text string, lang string")).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


OPS = {
    "store": lambda d: token_store.read_store(token_store.write_store(d)),
    "near": near_dedup.near_duplicates,
    "lm": lambda d: ngram_lm.score(d, ngram_lm.build(d)),
    "lang": lambda d: langid.classify(d, langid.fit(d)),
    "bpe": bpe.encode_decode,
    "prints": fingerprint.edited_fingerprints,
    "lines": lambda d: line_dedup.dedup_lines(d, 2),
}


@pytest.mark.parametrize("name", OPS)
def test_one_row_for_each_row(docs, none, name):
    out = OPS[name](docs)
    assert out.count() == len(ROWS)
    assert len(out.collect()[0]) == len(out.columns)
    assert OPS[name](none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS) and packing.pack(none).count() == 0


def test_near_results(docs):
    out = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=repr)
    by = {r[0]: r for r in out}
    assert by[5] == (5, 4, 4, False) and by[4] == (4, 4, 4, True) and by[None][2:] == (None, True)
    assert by[1] == (1, 0, 1, True) and by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True) and by[8][1] == 1


def test_language_results(docs):
    out = {r.doc_id: r for r in langid.classify(docs, langid.fit(docs)).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (1, 2, 3, 8))
    assert out[6].lang_pred == "en" and out[4].row == "clash"


def test_line_results(docs):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, 2).collect()}
    assert out[4].n_dropped == 1 and out[4].kept_text == "" and out[1].n_lines == 1 and out[1].n_dropped == 0
    assert out[3].kept_text == " \n\t\n" and out[6].kept_text == LONG
    assert out[6].row == out[6].lines == out[6].hits == "clash" and out[None].kept_text == "null id" and out[2].kept_text == ""
    assert out[7].n_lines == 1 and out[7].kept_text == ROWS[8][1]


def test_chat(spark):
    rows = [(1, 1, "user", "a <|end|> b"), (1, 1, "user", "a <|end|> b"), (1, None, None, None), (1, 2, "", ""), (2, 1, "system", "x"), (None, 1, "bob", "y"), (3, 5000, "amy", LONG)]
    d = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {(r.conv_id, r.speaker): r for r in chat.rotate(d).collect()}
    assert set(out) == {(1, "user"), (None, "bob"), (3, "amy")}
    r = out[(1, "user")]
    assert r.n_turns == 4 and r.n_spans == 2 and r.rendered.count("<|end|>") == 4
    for span in r.spans.split(","):
        a, b = map(int, span.split("-"))
        assert r.rendered[a:b] == "a < |end| > b<|end|>"
    assert out[(3, "amy")].part == out[(3, "amy")].offset == 0 and chat.rotate(d.limit(0)).count() == 0


def test_long_dialogues_come_in_parts(spark):
    """The parts of a dialogue, put together, are the dialogue; none is much longer than it may be."""
    rows = [(c, t if t % 7 else None, r, f"turn {t} of {c}" * (t % 4)) for c, n in ((1, 300), (None, 90), (3, 2)) for t in range(n) for r in ("amy", "bob", "system")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {(r.conv_id, r.speaker): r for r in chat.rotate(d).collect()}
    parts = sorted(chat.rotate(d, part_chars=3000).collect(), key=lambda r: (str(r.conv_id), r.speaker, r.part))
    assert len(whole) == 6 and len(parts) > 40
    for key, r in whole.items():
        mine = [p for p in parts if (p.conv_id, p.speaker) == key]
        assert "".join(p.rendered for p in mine) == r.rendered and sum(p.n_turns for p in mine) == r.n_turns
        spans = [f"{a + p.offset}-{b + p.offset}" for p in mine for a, b in (map(int, s.split("-")) for s in p.spans.split(",") if s)]
        assert ",".join(spans) == r.spans
    assert max(len(p.rendered) for p in parts) < 3200


def test_parts_in_many_ranges(spark):
    """The parts are the dialogue however its turns are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_long_dialogues_come_in_parts(spark)
        rows = [(1, None, r, f"{'same beginning ' * (t % 3)}turn {t * 7919 % 300}") for t in range(300) for r in ("amy", "bob")]
        d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        whole = {r.speaker: r.rendered for r in chat.rotate(d).collect()}
        parts = sorted(chat.rotate(d, part_chars=3000).collect(), key=lambda r: r.part)
        assert {s: "".join(p.rendered for p in parts if p.speaker == s) for s in whole} == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_languages_of_long_texts_only(spark):
    """Long labelled texts teach their language, be they longer than the budget too."""
    import random

    rng = random.Random(3)
    said = {"en": "the of and to in that was his with for", "fr": "le la des les une dans pour est que pas", "de": "der die und ist nicht ein das mit von sich"}
    text = lambda lang, size: " ".join(rng.choice(said[lang].split()) + rng.choice(["", "s", "e"]) for _ in range(size // 4))
    rows = [(text("en", 20000), "en") for _ in range(3)] + [(text("fr", 200000), "fr") for _ in range(2)] + [(text("de", 900), "de")]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    books = langid.fit(labelled)
    assert set(books) == {"en", "fr", "de"} and max(map(len, books.values())) <= langid.LANG_BYTES
    asked = spark.createDataFrame([(i, text(k, 3000), k) for i, k in enumerate(said)], "doc_id long, text string, want string")
    assert all(r.lang_pred == r.want for r in langid.classify(asked, books).collect())


def test_vectors(spark):
    rows = [(0, [0.5, 0.25]), (50, [1.0, 1.0]), (50, [2.0, 1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (7, []), (8, [1.0]), (9, [1e300, -1e300]), (100, [1e308, 1.0]), (10, [-1e7, 1e6]), (150, [1e7, -3e6])]
    d = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(d, d.filter("vec_id % 50 = 0")).collect())
    assert [r for r in out if r[0] == 0] == [(0, 1, 150, 128 * 2560000000 - 64 * 768000000), (0, 2, 50, 81920), (0, 3, 5, 49152), (0, 4, 6, 49152), (0, 5, 50, 49152)]
    assert [r[2] for r in out if r[0] == 150] == [50, 5, 6, 50, 0] and {r[0] for r in out} == {0, 50, 150}
    assert topk.search(d.limit(0), d.limit(0)).count() == 0 and topk.search(d, d.limit(0)).count() == 0
