import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid
from ledgerloom.llm.langid import DIMENSIONS, _letter_vector, fit_profiles, held_out, predict_language

PARTS = {"aa": ["tion", "the", "ing", "wh"], "bb": ["ßen", "sch", "ü", "keit"], "cc": ["eau", "é", "ois", "que"]}


def _rows(n=90):
    rng = random.Random(4)
    return [(i, " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 40))), lang) for i, lang in enumerate(rng.choices([*PARTS], k=n))]


def _bundle(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    total = np.zeros(DIMENSIONS)
    padded = " " + " ".join(words) + " "
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b != " ":
            total += np.roll(_letter_vector(ord(a)), 2) * np.roll(_letter_vector(ord(b)), 1) * _letter_vector(ord(c))
    return total


def test_profiles_and_scores_equal_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    profiles = fit_profiles(df)
    want = {lang: sum(_bundle(t) for _, t, name in rows if name == lang) for lang in PARTS}
    assert profiles.languages == sorted(PARTS)
    for lang, vector in zip(profiles.languages, profiles.vectors):
        assert vector == pytest.approx(want[lang] / np.linalg.norm(want[lang]))
    texts = {i: t for i, t, _ in rows}
    for r in predict_language(df, profiles).collect():
        own = _bundle(texts[r.doc_id])
        cosine = {lang: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for lang, v in want.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) == r.lang and r.score == pytest.approx(max(cosine.values()), abs=1e-4)


def test_undetermined_texts_ties_and_names(spark):
    rows = [(1, None, "aa", 3), (2, "", "aa", 3), (3, "123 .. !", None, 3), (4, "thething", "aa", 3), (4, "thething", "aa", 3), (None, "thething", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = predict_language(df, fit_profiles(df)).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got) == Counter({(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "aa"): 2, (None, "aa"): 1})
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    empty = df.limit(0)
    assert predict_language(empty, fit_profiles(empty)).count() == 0
    assert {r.lang_pred for r in predict_language(df, fit_profiles(empty)).collect()} == {"und"}


def test_held_out_rows(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_blocks_of_trigrams_give_the_same_answers(spark, monkeypatch):
    from ledgerloom.llm import langid
    from ledgerloom.llm.langid import Memory

    rng = random.Random(11)
    rich = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(4000))  # nearly as many trigrams as letters
    texts = [rich, "the tion ing", "", rich[:200] + " schau keit", "!!!"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    whole = Memory().bundles(data, offsets)
    monkeypatch.setattr(langid, "BLOCK", 70)
    monkeypatch.setattr(langid, "KNOWN", 150)
    memory = Memory()
    assert memory.bundles(data, offsets) == pytest.approx(whole) and len(memory.known) <= 150
    assert not whole[2].any() and not whole[4].any()
    monkeypatch.setattr(langid, "TEXTS", 2)
    rows = _rows(30) + [(900, rich, None), (901, None, "aa"), (902, "", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(df, fit_profiles(df)).collect()}
    assert len(got) == 33 and got[901] == got[902] == ("und", 0.0)


def test_broken_bytes_are_no_letters():
    broken, mended = [b"caf\xff\xc3 latte", b"\xe2\x82", b"plain"], ["caf�� latte".encode(), "�".encode(), b"plain"]

    def read(texts):
        rows, codes = langid._trigrams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        return rows.tolist(), codes.tolist()

    assert read(broken) == read(mended)
