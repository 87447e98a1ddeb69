import random
import re
import time
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.toxicity import ADDRESS, REPORTING, WINDOW, Scanner, ToxicityModel, Trie, _letter_sets, choose_terms, edits_allowed, fit_toxicity, score_toxicity, toxic_spans


@cache
def distance(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))


TERMS = ["abcde", "abd", "badcabdca", "cabcabd*", "ea*"]


@given(st.text("abcde", min_size=1, max_size=11))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_what_plain_distances_find(word):
    best = None
    for k, term in enumerate(TERMS):
        stem = term.rstrip("*")
        d = min(distance(word[:n], stem) for n in range(len(word) + 1)) if term.endswith("*") else distance(word, stem)
        if d <= edits_allowed(term) and (best is None or d < best[1]):
            best = (k, d)
    assert Trie(TERMS).match(word) == best


@given(st.lists(st.text("abcdeé1", min_size=1, max_size=11), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_words_that_are_not_walked_match_nothing(words):
    trie = Trie([*TERMS, "bécadéba", "éa1*"])
    parts = [w.encode() for w in words]
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    possible = trie.possible(*_letter_sets(np.frombuffer(b"".join(parts), np.uint8), starts, ends))
    assert all(ok for ok, w in zip(possible, words) if trie.match(w) is not None)


def _labelled(n=240):
    rng = random.Random(8)
    plain = ["".join(rng.choice("tionhers") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbolo", "vexx" + rng.choice(plain)]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_lexicon_and_scores_are_learned(spark):
    rows = _labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(df.select("doc_id", "text"), df.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    assert "grumbolo" in model.terms and any(t.startswith("vexx") and t.endswith("*") for t in model.terms)
    got = {r.doc_id: r.toxicity for r in score_toxicity(df, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 1)


def test_copies_are_no_evidence(spark):
    rows = _labelled(80) + [(1000 + i, "zanzibarus opened the long door", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(df.drop("toxic"), df.drop("text"))
    assert not any(t.startswith("zanz") for t in model.terms)


def test_spans_edits_and_quotation(spark):
    import numpy as np

    model = ToxicityModel(["grumbolo"], np.array([5.0, 0, 3, 0, 1]), -3.0)
    rows = [(1, "you Grumbolo!"), (2, 'he said "grumbolo" to them'), (3, "é grumbol0"), (4, "xgrum bolo"), (5, None), (5, None), (None, "grumbolo grumbolo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxic_spans(df, model).collect() if r.doc_id}
    assert (got[1].begin, got[1].end, got[1].edits, got[1].quoted, got[1].addressed) == (4, 12, 0, False, True)
    assert got[2].quoted and got[2].window_score < 0.5 and got[3].edits == 1 and got[3].begin == 3 and 4 not in got
    scores = {r.doc_id: r.toxicity for r in score_toxicity(df.withColumn("toxicity", df.doc_id), model).collect()}
    assert scores[1] > scores[3] > scores[4] == pytest.approx(scores[5]) and scores[2] < scores[1]


def test_empty_and_unlabelled_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = fit_toxicity(df.drop("toxic"), df.drop("text"))
    assert model.terms == [] and score_toxicity(df, model).count() == 0
    one = spark.createDataFrame([(1, "a", None), (2, None, 1), (3, "", 0)], "doc_id long, text string, toxic int")
    assert score_toxicity(one, fit_toxicity(one.drop("toxic"), one.drop("text"))).filter("toxicity between 0 and 1").count() == 3


def test_a_term_falls_away_only_for_one_that_covers_it():
    assert choose_terms({"scum": 300, "scumbag": 12, "scum*": 312}) == ["scum", "scumbag"]
    assert choose_terms({"vexxab": 30, "vexxcd": 30, "vexx*": 60}) == ["vexx*"]
    assert choose_terms({"grumbolo": 50, "grum*": 51, "grumb*": 50, "other": 5}) == ["grumbolo", "other"]
    assert choose_terms({}) == []


def _plain_features(text, terms):
    """FEATURES of an ASCII text, word by word and without a trie."""
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer("[A-Za-z0-9]+", text or "")]
    found = []
    for _, _, word in words:
        best = None
        for k, term in enumerate(terms):
            stem = term.rstrip("*")
            d = min(distance(word[:n], stem) for n in range(len(word) + 1)) if term.endswith("*") else distance(word, stem)
            if d <= edits_allowed(term) and (best is None or d < best[1]):
                best = (k, d)
        found.append(best)
    sums, kinds = [0.0] * 4, set()
    for k, hit in enumerate(found):
        if hit is None:
            continue
        a, b = max(0, k - WINDOW), min(len(words), k + WINDOW + 1)
        near = {words[j][2] for j in range(a, b) if j != k}
        left = text[words[a - 1][1] if a else 0 : words[k][0]]
        right = text[words[k][1] : words[b][0] if b < len(words) else len(text)]
        quoted = any(left.count(q) % 2 == 1 and q in right for q in '"`')
        addressed = bool(near & ADDRESS)
        others = sum(found[j] is not None for j in range(a, b) if j != k)
        score = (0.2 if quoted else 0.5 if near & REPORTING else 1.0) * (1 + 0.5 * addressed + 0.25 * min(others, 4))
        sums[1 if quoted else 2 if hit[1] else 0] += score
        sums[3] += addressed and not quoted
        if not quoted and not hit[1]:
            kinds.add(hit[0])
    return np.log1p([*sums, len(kinds)])


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(12)
    terms = ["grumbolo", "vexx*", "zork", "blimpets"]
    words = ["grumbolo", "grumbol0", "vexxing", "vexy", "zork", "zorq", "blimpet", "you", "said", "the", "a1", "plain", "word", "house", '"', "`", '"zork"', "."]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))) for i in range(150)] + [(900, None), (901, ""), (902, "word " * 40_000 + "zork"), (902, "zork zork")]
    weights, bias = np.array([2.0, 0.3, 1.5, 0.7, 1.0]), -2.5
    model = ToxicityModel(terms, weights, bias)
    got = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()
    for r in got:
        assert r.toxicity == pytest.approx(1 / (1 + np.exp(-(_plain_features(r.text, terms) @ weights + bias)))), r.doc_id
    assert len(got) == len(rows)


def test_a_very_long_word_takes_no_longer_than_its_beginning():
    trie = Trie(["abcde*", "longestterm", "xyz"])
    began = time.perf_counter()
    data = np.frombuffer(b"abcde" + b"f" * 10_000_000 + b" longestterms " + b"q" * 10_000_000, np.uint8)
    hits = [(h[1], h[3]) for h in Scanner(trie).hits(data, np.array([0, len(data)]))]
    assert hits == [(0, 0), (10_000_006, 1)] and time.perf_counter() - began < 6
    rng = random.Random(3)
    for _ in range(300):  # what lies beyond the reach changes nothing
        word = "".join(rng.choice("abcdex") for _ in range(rng.randint(trie.reach, 40)))
        assert trie.match(word) == trie.match(word[: trie.reach]) == trie.match(word + "x" * 50)
