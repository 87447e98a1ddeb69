"""One pass against a pattern at a time; time that does not grow with the number of terms."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerloom.functions import onepass
from ledgerloom.functions.onepass import Lexicons

LISTS = {
    "topics": [("fees", "fee*"), ("visa", "visa"), ("fees", "premium processing"), ("queue", "backlog"), ("é", "été")],
    "places": ["new york", "york", "*berg", "ü"],
    "marks": ["!!", "*ix*", "c++"],
}


def pattern(term):
    core = re.escape(onepass.small(term.strip("*")))
    first, last = term.strip("*")[0], term.strip("*")[-1]
    before = r"(?<![\w])" if not term.startswith("*") and re.match(r"\w", first) else ""
    behind = r"(?![\w])" if not term.endswith("*") and re.match(r"\w", last) else ""
    return re.compile(f"(?={before}({core}){behind})")


def plain(text, lists):
    """Every term by itself: all places, then the leftmost and longest side by side."""
    out = []
    for own in lists.values():
        pairs = [(t, t) if isinstance(t, str) else t for t in own]
        hits = sorted(((m.start(1), -m.end(1)), label) for label, term in pairs for m in pattern(term).finditer(onepass.small(text)))
        n = free = 0
        for (start, end), _ in hits:
            if start >= free:
                n, free = n + 1, -end
        out.append((n, [label for label in dict.fromkeys(p[0] for p in pairs) if label in {h[1] for h in hits}]))
    return out


def test_equal_to_a_pattern_at_a_time():
    rng, lexicons = random.Random(5), Lexicons(LISTS)
    parts = ["fee", "fees", "coffee", "Visa", "visas", "premium processing", "New York", "york", "Heidelberg", "berg", "bergen", "été", "Été", "ixix", "mix", "c++", "c++x", "!!", "!!!!", "ü", "über", "_visa", "İ", ".", " ", " ", " ", "-", "\n"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert lexicons.tally(text) == plain(text, LISTS), text
    assert lexicons.tally(None) == lexicons.tally("") == [(0, [])] * 3


def test_time_does_not_grow_with_terms():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60_000))
    took = {}
    for n in (20, 4000):
        lexicons = Lexicons({"l": [f"{''.join(rng.choice('abcdefgh') for _ in range(9))}" for _ in range(n)]})
        lexicons.tally(text[:100])
        began = time.perf_counter()
        lexicons.tally(text)
        took[n] = time.perf_counter() - began
    assert took[4000] < 5 * took[20] + 0.05


def test_rules_over_a_scan(spark):
    rows = [(1, "A fee in New York, a VISA"), (2, "backlog backlog"), (3, "nothing here"), (4, None), (5, "Heidelberg"), (6, "visa Heidelberg")]
    found = spark.createDataFrame(rows, "k int, t string").select("k", onepass.scan(F.col("t"), Lexicons(LISTS)).alias("f"))
    topics, places = F.col("f.topics"), F.col("f.places")
    got = {r.k: (r.first, r.n, r.category, r.topic, r.labels) for r in found.select(
        "k", onepass.first_label(topics).alias("first"), topics["n"].alias("n"), onepass.one_category(topics, onepass.flag(places)).alias("category"), onepass.topic(topics).alias("topic"),
        onepass.taxonomy(places, ["*berg", "york", "base"], F.when(F.col("k") == 2, F.array(F.lit("base"))), {"*berg": onepass.flag(topics)}).alias("labels"),
    ).collect()}
    assert got == {
        1: ("fees", 2, "cross-cutting", "fees", ["york"]), 2: ("queue", 2, "queue", "queue", ["base"]), 3: (None, 0, None, "policy", ["general"]), 4: (None, 0, None, "policy", ["general"]),
        5: (None, 0, "cross-cutting", "policy", ["general"]), 6: ("visa", 1, "visa", "visa", ["*berg"]),
    }
