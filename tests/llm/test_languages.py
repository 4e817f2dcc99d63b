import math
from pathlib import Path

import numpy as np
import pytest

from fedlens.llm import languages as L

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, id string, label string, seg_no string"


@pytest.fixture(scope="module")
def tables(spark):
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/languages.parquet")


def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    p = np.array([0.1, 0.2, 0.15, 0.1, 0.25, 0.19, 0.01])
    model = L.Pieces(names, np.log(p)[:, None])

    def brute(s):
        return 1.0 if not s else sum(p[names.index(s[:k])] * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in names)

    for word in ("a", "ab", "aab", "abab"):
        assert math.exp(model.forward(word)[-1][0]) == pytest.approx(brute("▁" + word))
    uses = model.expected("ab")
    assert sum(u[0] * len(names[i]) for i, u in uses.items()) == pytest.approx(3)  # every segmentation covers all letters
    assert np.isfinite(model.forward("xyz" * 50)[-1]).all()


def test_words_and_sentences_leave_out_codes_numbers_and_units():
    assert L.words("The pump ZU-795 used 486.2ms, 12 kW, 35.5% (2238.0°C) Ärger.") == ["the", "pump", "used", "arger"]
    assert L.sentences("One. Two! Three (4.5). | Four\nfive") == ["One.", "Two!", "Three (4.5).", "Four", "five"]


def test_a_word_in_which_a_text_breaks_off_has_no_language():
    assert L.unbroken("One two. A thir", [["one", "two"], ["a", "thir"]]) == [["one", "two"], ["a"]]
    assert L.unbroken("One two.", [["one", "two"]]) == [["one", "two"]] and L.unbroken("One", [["one"]]) == [["one"]]
    assert L.unbroken("One. Two 4.5km", [["one"], ["two"]]) == [["one"], ["two"]] and L.unbroken("", []) == []


def test_labels():
    forms = {"en": "en", "eng": "en", "english": "en", "pt": "pt"}
    assert [L.labelled(x, forms) for x in (" EN ", "eng", "English", "en-US", "en_GB", "pt_BR", "und", "", None, "??", "english (uk)")] == ["en", "en", "en", "en", "en", "pt", None, None, None, None, "en"]


def test_runs_keep_short_unclear_sentences_with_their_neighbours():
    score = np.array([[0.0, -20], [-1, 0], [0, -20], [-30, 0], [0, 0]])
    assert L.runs(score).tolist() == [0, 0, 0, 1, 1]


def test_held_out_accuracy(spark, tables):
    docs, langs = tables
    # held out: translations, which the model never saw, in a language that target_lang names for most rows
    held = docs.select("doc_id", docs["target_text"].alias("text"), docs["target_lang"].alias("lang")).filter("text is not null")
    forms = L.label_forms(langs)
    model, codes, scale = L.fit(docs, forms, "doc_id", "text", "lang")
    right = total = 0
    sure = {True: [], False: []}
    for r in held.collect():
        found = [w for s in L.sentences(r.text) for w in L.words(s)]
        code = L.labelled(r.lang, forms)
        if len(found) >= 5 and code:
            total += 1
            score = model.scores(found).sum(0)
            lang = int(score.argmax())
            right += codes[lang] == code
        if found and code:  # short ones too
            short = found[:2]
            score = model.scores(short).sum(0)
            lang = int(score.argmax())
            sure[codes[lang] == code].append(L.certainties(score[None], np.array([lang]), np.array([len(short)]), scale)[0])
    assert total > 500 and right / total > 0.85  # some target_lang are wrong and some texts mixed
    assert np.mean(sure[False]) < np.mean(sure[True]) - 0.05  # of the first two words alone, wrong ones look less certain


def test_calibration_finds_overconfidence_and_bears_wrong_labels():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 4, 4000)
    logit = rng.normal(0, 1, (4000, 4))
    logit[np.arange(4000), truth] += 2.0
    labels = np.where(rng.random(4000) < 0.1, rng.integers(0, 4, 4000), truth)
    t, b = L.calibrated(logit * 2 * 8, np.full(4000, 4), labels)
    assert 5 <= t * 4**b <= 12
    assert L.calibrated(np.zeros((0, 4)), np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_sentences_of_long_texts_are_sampled_whole(spark):
    long = " ".join(f"word{'abcdefghij'[i % 10]}" for i in range(2000)) + ". Second sentence here."
    docs = spark.createDataFrame([(1, long, "en"), (2, "Short one. Another.", "en"), (3, None, "en"), (None, "No id.", "en"), (4, "No label.", None)], "doc_id long, text string, lang string")
    got = L.sampled(docs, "doc_id", "text", "lang").collect()
    assert sum(r["i"] == 1 for r in got) == 41 and {r["t"] for r in got if r["i"] == 2} == {"Short one.", "Another."} and {r["i"] for r in got} == {1, 2}
    assert L.sampled(docs, "doc_id", "text", "lang", pieces=7).count() == 7


def test_mixed_text_missing_labels_and_dirt(spark, tables):
    real, langs = tables
    en = "My neighbour works slower than last year along the river. The night watch keeps the door half open."
    de = "Die Lieferdrohne sortiert die leeren Kisten im Keller zum ersten Mal."
    extra = [(900_001, f"{en} {de} {en}", "en"), (900_002, en.upper(), " English "), (900_003, en, None), (900_004, None, "en"), (900_005, "", "en"), (900_006, "12.5 kW ZU-795", "en"), (900_007, f"{en} 486.2ms. {de}", "und"), (900_008, (en + " ") * 3000, "en_GB"), (900_008, (en + " ") * 3000, "en_GB")]
    docs = real.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    docs = docs.selectExpr("*", "'x' as id", "'y' as label", "'z' as seg_no")
    parts = L.segments(docs, langs).filter("id > 900000")
    got = sorted((r.id, r.seg_no, r.lang) for r in L.mislabelled(parts).collect())
    assert got == [(900_001, 1, "en"), (900_001, 2, "de"), (900_001, 3, "en"), (900_003, 1, "en"), (900_007, 1, "en"), (900_007, 2, "de")]
    every = parts.collect()
    assert {r.id for r in every} == {900_001, 900_002, 900_003, 900_007, 900_008} and all(0.9 < r.confidence <= 1 for r in every)


def test_empty(spark, tables):
    _, langs = tables
    assert L.segments(spark.createDataFrame([], DOCS), langs).count() == 0
