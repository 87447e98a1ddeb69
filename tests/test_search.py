"""The index against scoring every entry for every query."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import search
from ledgerloom.operators.search import SearchIndex

ENTRIES = "id long, title string, section string, body string, question boolean"


def plain(tokens, title, section, body, question):
    fold = lambda s: re.sub("[^a-z0-9]+", "", s)
    title, section, body = ((s or "").lower() for s in (title, section, body))
    phrase = " ".join(tokens)
    total = 0 if len(phrase) <= 2 else 60 if phrase in title else 52 if phrase.replace(" ", "") in fold(title) else 0
    hits = points = 0
    for t in tokens:
        own = (26 if title.startswith(t) else 18 if t in title else 0) + (6 if t in section else 0)
        inside = t in body
        if own == 0 and not inside:
            own = 22 if fold(title).startswith(t) else 16 if t in fold(title) else 5 if t in fold(section) else 0
            late = own == 0 and t in fold(body)
        else:
            late = False
        total += own
        points += 4 if inside else 3 if late else 0
        hits += bool(own or inside or late)
    return total + min(points, 12) + int(22 * hits / len(tokens) + 0.5) + 5 * bool(question) if hits else 0


def made(n, seed):
    rng = random.Random(seed)
    words = ["green", "card", "H-1B", "fee", "fees", "Café", "I-140", "what is", "a", "of", "premium", "pro-cessing", "visa", "漢字", "x"]
    pick = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    return [(i, rng.choice([pick(5), None]), pick(2), pick(30), rng.random() < 0.3) for i in range(n)]


def test_several_hundred_queries_at_once(spark, tmp_path):
    entries, rng = made(180, 3), random.Random(4)
    tokens = ["green", "car", "h1b", "h-1b", "fee", "a", "of", "i140", "i-1", "processing", "visa", "é", "zz", "xgreen", "greencard", "漢", "um p"]
    queries = [(q, [rng.choice(tokens) for _ in range(rng.randint(1, 4))]) for q in range(300)]
    index = SearchIndex.build(spark.createDataFrame(entries, ENTRIES), str(tmp_path / "index"))
    got = {}
    for r in index.search(spark.createDataFrame(queries, "query long, tokens array<string>")).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, r.score))
    for query, own in queries:
        scored = sorted((-s, e[0]) for e in entries if (s := plain(own, *e[1:])) > 0)[:12]
        assert sorted(got.get(query, [])) == [(k, i, -s) for k, (s, i) in enumerate(scored, 1)], own
    # The column that scores one query over all entries gives the same.
    frame = spark.createDataFrame(entries, ENTRIES)
    for query, own in queries[:6]:
        columns = text.relevance(own, F.col("title"), F.col("section"), F.col("body"), F.col("question"))
        assert {r.id: r.s for r in frame.select("id", columns.alias("s")).collect()} == {e[0]: plain(own, *e[1:]) for e in entries}


def test_a_search_reads_the_lists_of_its_tokens(spark, tmp_path):
    rows = [(k, f"entry {k}", "", "common words", False) for k in range(400)] + [(999, "zyzzyva", "", "", True)]
    index = SearchIndex.build(spark.createDataFrame(rows, ENTRIES), str(tmp_path / "index"))
    asked = spark.createDataFrame([("q", ["zyzzyva"]), ("none", ["qqq"]), ("empty", [])], "query string, tokens array<string>")
    assert [(r.query, r.id) for r in index.candidates(asked).collect()] == [("q", 999)]
    assert [tuple(r) for r in index.search(asked).collect()] == [("q", 1, 999, 60 + 26 + 22 + 5)]
    again = SearchIndex(spark, index.folder)  # another session opens it by its folder
    assert again.search(asked.filter("query = 'q'")).count() == 1
    empty = SearchIndex.build(spark.createDataFrame([], ENTRIES), str(tmp_path / "none"))
    assert empty.search(asked).count() == 0


def test_many_searches_make_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    entries, rng = made(150, 5), random.Random(6)
    tokens = ["green", "car", "h1b", "h-1b", "fees", "of", "what is", "i140", "processing", "xgreen", "漢"]
    queries = [(q, [rng.choice(tokens) for _ in range(rng.randint(0, 4))] + [""] * (q % 9 == 0)) for q in range(200)]
    index = SearchIndex.build(spark.createDataFrame(entries, ENTRIES), str(tmp_path / "index"))
    monkeypatch.setattr(search, "LEAST_SLICE", 40)
    monkeypatch.setattr(search, "MOST_ASKED", 70)
    monkeypatch.setattr(SearchIndex, "candidates", None)
    got = {}
    for r in index.search(spark.createDataFrame(queries, "query long, tokens array<string>"), 5).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, r.score))
    for query, own in queries:
        own = [t for t in own if t]
        scored = sorted((-s, e[0]) for e in entries if own and (s := plain(own, *e[1:])) > 0)[:5]
        assert sorted(got.get(query, [])) == [(k, i, -s) for k, (s, i) in enumerate(scored, 1)], own
