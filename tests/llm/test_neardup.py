import random
import re

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.neardup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, share):
    sets = {}
    for i, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.setdefault(i, []).append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def _corpus(seed, n, base_words=60, families=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    bases = [[word() for _ in range(base_words)] for _ in range(families)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, 50))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if text:
                text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text).title() if rng.random() < 0.2 else " ".join(text)))
    return rows


def test_classes_equal_brute_force(spark):
    rows = _corpus(4, 250) + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a"), (906, "a b c d"), (907, "a b c d")]
    want = brute(rows, 4, 80)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert got[900].n_shingles == 0 and got[903].n_shingles == 1 and got[904].component_id == 903 and got[902].component_id == 902


def test_hot_values_and_many_blocks(spark, monkeypatch):
    from ledgerloom.llm import neardup

    monkeypatch.setattr(neardup, "HOT", 6)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = _corpus(9, 160, families=2)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=4).collect()}
    assert got == brute(rows, 4, 80)


def test_keys_that_are_sent_to_the_rows(spark, monkeypatch):
    from ledgerloom.llm import neardup

    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "HOT_KEYS", 700)  # few postings a key: most stars are of such keys
    rows = _corpus(11, 120, families=3) + [(500, "q " * 40_000), (501, "long text " + "w x y z " * 30_000), (502, "w x y z " * 30_000)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute(rows, 4, 80)


def test_nulls_repeated_ids_extra_columns_and_empty(spark):
    rows = [(1, "x y z w v", 5), (1, "x y z w v", 5), (None, "x y z w v", 5), (2, "X y z w v", 5), (3, "p q r s t", 5), (3, "x y z w v", 5)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True)]
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5), (9, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3}
