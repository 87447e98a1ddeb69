import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.quality import fit_rules, score_quality, text_features, votes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def _texts():
    rng = random.Random(5)
    parts = ["a", "b", "é", "漢", " ", " ", " ", "\n", "\t", "\r\n", "|", "the cat sat", "\x1c", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", None, "\n\n", "x", "a b c a b c", "x\nx\nx", " x\nx"]


def test_counts_equal_brute_force(spark):
    texts = _texts()
    got = text_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in got:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute(texts[row.doc_id]), repr(texts[row.doc_id])


def test_verdicts(spark):
    prose = " ".join(f"word{i}x" for i in range(60)).translate(str.maketrans("0123456789", "abcdefghij")) + "."
    junk = " ".join(f"w{chr(97 + i % 26)}*** x{chr(97 + i // 26)}###" for i in range(60))
    rows = [(i, prose) for i in range(40)] + [(100 + i, junk) for i in range(8)] + [(200, None), (201, "short."), (202, "spam spam spam " * 40)]
    got = {r.doc_id: r for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[100 + i].kept for i in range(8))
    assert got[200].base_failed and got[201].base_failed and got[202].base_failed and not got[202].kept


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept int, n_words string")
    got = score_quality(empty)
    assert got.count() == 0 and dict(got.dtypes)["kept"] == "boolean" and dict(got.dtypes)["n_words"] == "bigint"


def test_expectation_maximisation_matches_a_plain_loop(spark):
    import math

    rows = [(60, 300, s, 0, r, 4, c, 40, le, 300) for s, r, c, le, k in [(0, 0, 4, 295, 50), (30, 0, 1, 200, 9), (0, 40, 4, 295, 3), (9, 0, 3, 250, 2)] for _ in range(k)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_distinct_words", "n_letter_bytes", "n_word_bytes"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    from ledgerloom.llm.quality import votes

    table = [list(r) for r in df.select(*[v.alias(k) for k, v in votes().items()]).collect()]
    model, k = fit_rules(df, rounds=7), len(votes())
    prior, acc = 0.8, [0.8] * k
    for _ in range(7):
        good = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(row, acc))))) for row in table]
        fresh = []
        for j in range(k):
            right = sum(g if row[j] > 0 else 1 - g for g, row in zip(good, table) if row[j])
            fresh.append(min(0.99, max(0.5, (right + 0.8) / (sum(abs(row[j]) for row in table) + 1))))
        prior, acc = min(0.95, max(0.05, sum(good) / len(good))), fresh
    assert model.prior == pytest.approx(prior) and list(model.accuracy.values()) == pytest.approx(acc)


def test_a_text_of_few_words_is_found_at_any_length(spark):
    rng = random.Random(1)
    junk = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)]
    prose = [f"{a}{b}{c}" for a in "tionhers" for b in "aeiou" for c in ("ther", "ing", "man", "ship")]
    few = lambda n: " ".join(rng.choice(junk) for _ in range(n))
    many = lambda n: " ".join(rng.choice(prose) + rng.choice(prose) for _ in range(n))
    rows = [(n, few(n)) for n in (200, 1999, 2000, 60_000)] + [(-n, many(n)) for n in (200, 1999, 2000, 60_000)]
    df = text_features(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False)
    got = {r.doc_id: r.v for r in df.withColumn("v", votes()["variety"]).select("doc_id", "v").collect()}
    assert all(got[n] == -1 and got[-n] == 0 for n in (200, 1999, 2000, 60_000))


def test_hashes_tell_patterned_words_apart():
    import numpy as np

    from ledgerloom.llm.words import hashes

    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    flipped = thue.translate(str.maketrans("ab", "ba"))
    rng = random.Random(3)
    words = {thue, flipped, *("".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 63, 64, 65, 128, 500) for _ in range(40))}
    words |= {w[:k] + "c" + w[k + 1 :] for w in (thue, flipped) for k in (0, 63, 64, 2000, 4095)}
    ordered = sorted(words)
    data = np.frombuffer("".join(ordered).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in ordered])
    assert len(set(hashes(data, ends - [len(w) for w in ordered], ends).tolist())) == len(ordered)


def test_signs_and_emoji_are_no_letters(spark):
    rows = [(1, "abc défg"), (2, "😀😀 ━━ →→ 。。 «»"), (3, "漢字 ß"), (4, "x😀é")]
    got = {r.doc_id: (r.n_letter_bytes, r.n_word_bytes) for r in text_features(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (8, 8), 2: (0, 30), 3: (8, 8), 4: (3, 7)}
