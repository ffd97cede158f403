"""The string kernel against sets, the regression against its closed form, held-out accuracy, edges."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.data import DOCS
from wattledger.llm import langid

ENDS = {"en": ["ing", "the", "ed"], "fr": ["eux", "é", "tion"], "de": ["ung", "ä", "isch"]}


def text_of(rng, lang, n):
    return " ".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") + rng.choice(ENDS[lang]) for _ in range(n))


def grams(text):
    """Sets of n-grams of letters, everything else being one symbol."""
    s = "\0" + "".join(c.lower() if c.isalpha() else "\0" for c in text) + "\0"
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n].strip("\0")}


def test_kernel_counts_shared_ngrams():
    rng = random.Random(2)
    marks = [text_of(rng, lang, 20) for lang in ENDS]
    texts = ["", "12 !", "Bad ING, the x", marks[0], marks[1].upper(), text_of(rng, "de", 300), "a" * 5]
    scorer = langid.Scorer(langid.landmarks_of(marks, sorted(ENDS)))
    kernel, sizes = scorer.kernel(texts)
    for k, text in enumerate(texts):
        # letters that no landmark has are one symbol
        own = {"".join(c if c == "\0" or c in scorer.model.alphabet else "?" for c in g) for g in grams(text)}
        assert sizes[k] == len(own)
        for m, mark in enumerate(marks):
            expected = len(own & grams(mark)) / np.sqrt(max(len(own), 1) * len(grams(mark)))
            assert abs(kernel[k, m] - expected) < 1e-6
    assert abs(kernel[3, 0] - 1) < 1e-6 and abs(kernel[4, 1] - 1) < 1e-6


def test_long_texts_are_read_in_stretches(monkeypatch):
    rng = random.Random(3)
    marks = [text_of(rng, lang, 40) for lang in ENDS]
    texts = [text_of(rng, lang, 200) for lang in ENDS]
    model = langid.landmarks_of(marks, sorted(ENDS))
    whole = langid.Scorer(model).kernel(texts)
    monkeypatch.setattr(langid, "STRETCH", 7)
    cut = langid.Scorer(model).kernel(texts)
    assert np.allclose(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def test_all_texts_as_landmarks_give_kernel_ridge_regression():
    rng = random.Random(4)
    langs = [rng.choice(sorted(ENDS)) for _ in range(30)]
    texts = [text_of(rng, lang, 15) for lang in langs]
    model = langid.landmarks_of(texts, sorted(ENDS))
    kernel = langid.Scorer(model).kernel(texts)[0]
    y = np.array([sorted(ENDS).index(lang) for lang in langs])
    langid.fit(model, kernel, y, ridge=0.01)
    expected = kernel @ np.linalg.solve(kernel + 0.01 * len(y) * np.eye(len(y)), np.eye(3)[y])
    assert np.abs(kernel @ model.weights - expected).max() < 1e-4


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(ENDS))
        rows.append((i, text_of(rng, lang, rng.randint(5, 60)), lang if i % 11 else None, "s", 1))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "12 + 3!", "de", "s", 1), (None, rows[1][1], "zz", "s", 1)]
    rows += [rows[1]] * 3 + [(903, text_of(rng, "fr", 90_000), None, None, None)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("clash"), "n": F.lit("clash"), "kernel": F.lit("clash")})
    got = langid.identify(spark, frame).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:240]}
    held = [r for r in got if r["held_out"] and truth.get(r["doc_id"])]
    assert len(held) > 40 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[903]["lang_pred"] == "fr" and by_id[None]["held_out"] is False
    assert "zz" not in {r["lang_pred"] for r in got} and all(0 <= r["score"] <= 1 for r in got)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
    again = langid.identify(spark, frame.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_nothing_to_learn_and_empty_table(spark):
    frame = spark.createDataFrame([(0, "some text", None, "s", 1)], DOCS)
    assert [tuple(r) for r in langid.identify(spark, frame).collect()] == [(0, zlib.crc32(b"0") % 3 == 1, "und", 0.0)]
    assert langid.identify(spark, spark.createDataFrame([], DOCS)).collect() == []
