import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.divergence import divergence, joined_transducer, minimal_transducer, shares, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)
        p = {}
        for s in [*own, None]:
            count = counts[lang, s] if s is not None else sum((counts[lang, o] for o in own), Counter())
            total = sum(count[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "漢字", "x_y", "don't", "gamma9delta", "a", "ab", "abc", "b", "zz", "Ω", "\U0001f600", "ﬀ"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(6)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 4 + ["s1", "s2", "é", None])) for i in range(n)]


def answers(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("route", [{}, {"sent_bytes": 0}, {"shard_terms": 7}, {"shard_terms": 7, "sent_bytes": 0}])
def test_equal_to_a_plain_audit(spark, route):
    rows = made(160, 2) + [(500, None, "fr", "s1"), (501, "", "fr", "s2"), (502, "one two", "it", "s1"), (503, "...", "en", "empty"), (504, "wab " * 50_000, "de", "s1"), (505, "q" * 100_000, "de", "s2")]
    got = answers(source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), **route))
    assert got == plain(rows)
    assert {r[2] for r in got} == {"pair", "term"}


def test_ranks_are_cut_with_ties_in_byte_order(spark):
    rows = [(i, "zz é b a Z2", "en", "s") for i in range(3)] + [(9, "other a", "en", "t")] * 3
    got = answers(source_divergence(spark.createDataFrame(rows, SCHEMA), top=2))
    assert got == plain(rows, top=2)
    assert sum(r[2] == "term" for r in got) == 4


def test_empty_table_and_clashing_columns(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, "same words here", "en", "s" if i % 2 else "t", 1, "x") for i in range(8)]
    frame = spark.createDataFrame(rows, SCHEMA + ", rank int, item string")
    assert answers(source_divergence(frame)) == plain([r[:4] for r in rows])


words = st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 4 for x in b)), min_size=1, max_size=60, unique=True).map(sorted)


def read(machine, terms, root):
    ends = np.cumsum([len(t) for t in terms])
    return machine.ordinals(np.frombuffer(b"".join(terms) + b" ", np.uint8), ends - [len(t) for t in terms], ends, np.full(len(terms), root)).tolist()


@given(words, words)
@settings(max_examples=120, deadline=None)
def test_ordinals_are_places_in_order(terms, others):
    machine = minimal_transducer(terms)
    assert read(machine, terms, machine.roots[""]) == list(range(len(terms)))
    assert read(machine, others, machine.roots[""]) == [terms.index(t) if t in terms else -1 for t in others]


@given(words)
@settings(max_examples=60, deadline=None)
def test_states_are_the_different_sets_of_endings(terms):
    endings = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for t in terms for p in (t[:k] for k in range(len(t) + 1))}
    assert len(minimal_transducer(terms).final) == len(endings)


@given(words, words, st.integers(1, 9))
@settings(max_examples=120, deadline=None)
def test_joined_shards_read_as_one(terms, others, size):
    shards = [("en", minimal_transducer(terms[k : k + size])) for k in range(0, len(terms), size)] + [("de", minimal_transducer(others))]
    machine = joined_transducer(shards)
    assert read(machine, terms, machine.roots["en"]) == list(range(len(terms)))
    assert read(machine, others, machine.roots["en"]) == [terms.index(t) if t in terms else -1 for t in others]
    assert read(machine, others, machine.roots["de"]) == list(range(len(others)))
    assert read(machine, terms, -1) == [-1] * len(terms)


@given(st.integers(0, 10**13), st.integers(0, 10**13), st.integers(1, 10**9))
def test_shares_are_exact(count, rest, kept):
    total = count + rest
    assert shares(np.array([count]), np.array([total]), kept).tolist() == [1 + 10**9 * (count + 1) // (total + kept)]


@given(st.integers(1, 10**9 + 1), st.integers(1, 10**9 + 1))
def test_divergence_holds_in_64_bits(p, q):
    assert divergence(np.array([p]), np.array([q])).tolist() == [(p - q) ** 2 // q]
