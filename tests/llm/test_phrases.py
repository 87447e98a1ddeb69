import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm.phrases import PhraseGraph, collocations

SCHEMA = "text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """Counts of one to four words by language."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return counts


def plain(rows, least=30, share=80, top=2000):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        phrases = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        found = []
        for g, a in phrases.items():
            inside = lambda other: any(other[i : i + len(g)] == g for i in range(len(other) - len(g) + 1))  # noqa: B023, E731
            if any(len(o) > len(g) and 100 * c >= share * a and inside(o) for o, c in phrases.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def answers(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def made(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "one", "été", "漢字", "x-1", "a", "b", "c's", "\x1c", "d"] + [f"rare{k}" for k in range(400)]
    passage = "it is a long passage, that all of them share word by word and then some"
    rows = []
    for k in range(n):
        parts = [rng.choice(words[: rng.choice([4, 12, 412])]) + rng.choice([" "] * 9 + ["\t", ". ", "\n", ", ", "  ", ";"]) for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), f" {passage}{rng.choice(['.', '', '!'])} ")
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("options", [{}, {"sent_words": 0}, {"part_words": 700}, {"part_words": 700, "sent_words": 0}])
def test_equal_to_plain_counts(spark, options):
    rows = made(240, 4) + [(None, "en"), ("", "de"), ("a b " * 5000, "fr"), ("q" * 100_000, "en"), ("the " * 3000, "en"), ("one of", "only")]
    least = 12
    got = answers(collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least, **options))
    assert got == plain(rows, least) and len({r[0] for r in got}) == 4


def test_flows_are_counts_and_paths_their_longest_runs(spark):
    rows = made(150, 8)
    graph = PhraseGraph(spark.createDataFrame(rows, SCHEMA), 10, part_words=2_000)
    names = {r.id: (r.lang, bytes(r.word).decode()) for r in graph.words.collect()}
    ids = [1 + k for k in range(len(names))]
    assert sorted(names) == ids and [r.n for r in graph.words.orderBy("id").collect()] == sorted((r.n for r in graph.words.collect()), reverse=True)
    flows = {}
    for r in graph.flows.collect():
        own = [names[i] for i in (r.k1 >> 32, r.k1 & 0xFFFFFFFF, r.k2 >> 32, r.k2 & 0xFFFFFFFF) if i]
        flows[own[0][0], tuple(w for _, w in own)] = r.f
    counts = counted(rows)
    assert flows == {(lang, g): c for lang, f in counts.items() for g, c in f.items() if c >= 10}
    passages = {(r.lang, r.phrase): (r.words, r.n) for r in graph.passages().collect()}
    edges = Counter()
    for (lang, phrase), (n, times) in passages.items():
        words = tuple(phrase.split(" "))
        assert len(words) == n
        for i in range(n - 3):
            edges[lang, words[i : i + 4]] += 1
            assert counts[lang][words[i : i + 4]] == times
        for i in range(1, n - 3):  # what lies between two edges of a path passes all its flow
            assert counts[lang][words[i : i + 3]] == times
    assert edges == Counter({k: 1 for k, c in flows.items() if len(k[1]) == 4})
    assert max(n for n, _ in passages.values()) >= 9


def test_top_ties_and_shares(spark):
    rows = [("p q. q p. é z. z é", "en")] * 30 + [("x y z w", "en")] * 40 + [("x y z", "en")] * 10 + [("x y", "en")] * 13
    frame = spark.createDataFrame(rows, SCHEMA)
    for share, top in ((80, 2000), (79, 3), (100, 2000), (60, 1)):
        assert answers(collocations(frame, share=share, top=top)) == plain(rows, 30, share, top)


def test_empty_table_and_clashing_columns(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("good morning", "en")] * 40
    assert answers(collocations(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, word string"))) == plain(rows)
    assert collocations(spark.createDataFrame([("few words", "en")], SCHEMA)).count() == 0
