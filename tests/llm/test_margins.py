"""What the operators' estimates and margins must not lose."""

import numpy as np
import pytest

from loam.llm import fingerprint, langid, near_dedup


def pairs_at(spark, union, both):
    """2000 pairs of sets with that many shingles in common, as near_dedup has them before the join."""
    import pandas as pd

    k, mine = 2000, both + (union - both) // 2
    h = np.random.default_rng(5).integers(0, 1 << 64, (k, union), dtype=np.uint64)
    row = {}
    for side, sets in (("a", h[:, :mine]), ("b", np.concatenate([h[:, :both], h[:, mine:]], 1))):
        n = np.full(k, sets.shape[1])
        filled, bins = near_dedup.binned_sketch(sets.ravel(), n)
        row |= {f"n{side}": n, f"odd{side}": near_dedup.odd_sketch(sets.ravel(), n).tolist(), f"filled{side}": filled, f"bins{side}": bins.tolist()}
    return spark.createDataFrame(pd.DataFrame(row), "na long, odda array<long>, filleda int, binsa array<long>, nb long, oddb array<long>, filledb int, binsb array<long>")


@pytest.mark.parametrize("union", [60, 200, 400, 1000, 1400, 3000])
def test_prefilter_keeps_links(spark, union):
    """Pairs of similarity exactly 0.75 pass the odd sketches."""
    assert pairs_at(spark, union, union * 3 // 4).filter(near_dedup.likely()).count() == 2000


@pytest.mark.parametrize("union, both", [(60, 42), (200, 138), (400, 270), (1000, 640), (3000, 1750)])
def test_prefilter_is_sharp(spark, union, both):
    """Pairs of similarity 0.70, 0.69, 0.68, 0.64 and, by samples, 0.58 hardly ever do."""
    assert pairs_at(spark, union, both).filter(near_dedup.likely()).count() < 100


def prose(seed, words, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words.split(), n))


def test_short_clean_texts_stay(spark):
    """Texts too short for any dictionary to save a byte are kept, with the language that their letters tell."""
    en, fr = "this that with the have from there which would other water gate house", "avec pour dans les cette mais leur sont nous vous être eau porte maison"
    taught = [(prose(i, w, 300), lang) for i in range(20) for w, lang in ((en, "en"), (fr, "fr"))]
    dictionaries = langid.fit(spark.createDataFrame(taught, "text string, lang string"))
    texts = {"This.": "en", "Avec.": "fr", "which would": "en", "leur eau": "fr", "Which, " * 1000: "en"}
    out = {r.text: r for r in langid.classify(spark.createDataFrame([(t,) for t in texts], "text string"), dictionaries).collect()}
    assert {t: (r.lang_pred, r.rejected) for t, r in out.items()} == {t: (lang, False) for t, lang in texts.items()}


def test_gibberish_goes(spark):
    """Long texts of no language learned are rejected, however their sizes differ."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(3)
    made = [(" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(200)),) for _ in range(200)]
    dictionaries = langid.fit(docs)
    out = langid.classify(spark.createDataFrame(made, "text string"), dictionaries)
    assert out.filter("rejected").count() == 200
    clean = langid.classify(docs.filter("n_chars < 60 AND text RLIKE '[a-zA-Z]'"), dictionaries)
    assert clean.filter("rejected").count() == 0 and clean.count() > 5


def test_likeness_of_very_long_texts(spark):
    """near_edited estimates the share of pieces in common whatever their number."""
    from collections import Counter

    n, docs = 24000, 6
    texts = [[f"d{d} s{i:05d}. " for i in range(n)] for d in range(docs)]
    out = fingerprint.edited_fingerprints(spark.createDataFrame([(d, "".join(t)) for d, t in enumerate(texts)], "doc_id int, text string")).collect()
    exact = []
    for d in range(docs):
        a, b = Counter(texts[d]), Counter(texts[d][: n // 2] + texts[d - 1][: n // 2])
        exact.append((a & b).total() / (a | b).total())
    assert abs(sum(r.near_edited for r in out) / docs - sum(exact) / docs) < 0.15
    assert all(r.near_edited > 0.1 and r.near_next < 0.05 for r in out)
