import hashlib
import random
from collections import defaultdict

import pytest

from ledgerloom.llm.mixing import mix_sources, mixture


def _targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """Water filling: stop sources at their limit one by one, reshare the rest."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * share for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def _rows(n=400, sources=("a", "b", "c", "d", None)):
    rng = random.Random(2)
    return [(i, "w " * rng.randint(0, 40) if i % 17 else None, rng.choice(sources) if i % 3 else "a") for i in range(n)]


def test_targets_and_taken_words(spark):
    rows = _rows()
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
        assert r.size == len((r.text or "").split()) and r.taken in (0, r.size, 2 * r.size)
    want = _targets(dict(size))
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
    total = sum(taken.values())
    assert 1.5 * sum(size.values()) - max(biggest.values()) < total <= 1.5 * sum(size.values())
    for s in size:  # each lags by less than a document; what the others lag is shared
        assert -biggest[s] <= taken[s] - want[s] <= sum(biggest.values())


def test_taken_equals_a_sorted_and_truncated_queue(spark):
    """The whole order, plainly: every document and pass by finish time, taken until the budget is used up."""
    rows = _rows()
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=5).collect()
    names = sorted({r.source for r in got} - {None}) + [None]
    entries = []
    for number, name in enumerate(names):
        queue = sorted((r for r in got if r.source == name), key=lambda r: (hashlib.md5(f"5:{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else ''}".encode()).hexdigest(), r.doc_id))
        ends, whole, weight = 0, sum(r.size for r in queue), (5, 2, 1)[number % 3]
        for r in queue:
            ends += r.size
            entries += [((p * whole + ends) / weight, name is not None, name or "", r.size, r.doc_id) for p in (0, 1) if r.size]
    taken, words, budget = defaultdict(int), 0, 1.5 * sum(r.size for r in got)
    for *_, size, doc in sorted(entries):
        words += size
        if words <= budget:
            taken[doc] += size
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: taken[r.doc_id] for r in got}


def test_columns_of_any_name_and_a_very_long_text(spark):
    schema = "doc_id long, text string, source string, weight int, size int, `__key` string, row int, key int, queue int, range int, before int, ends int, time int, inside int"
    rows = [(i, "w " * (50_000 if i == 3 else 20), "ab"[i % 2], 1, 2, "k", *range(8)) for i in range(60)]
    docs = spark.createDataFrame(rows, schema)
    got = mix_sources(docs).collect()
    assert len(got) == 60 and {r.size for r in got} == {50_000, 20} and got[0].weight == 1 and got[0]["__key"] == "k"
    assert mixture(docs).columns == docs.columns


def test_all_is_taken_where_the_budget_allows(spark):
    df = spark.createDataFrame(_rows(60), "doc_id long, text string, source string")
    assert all(r.taken == 2 * r.size for r in mix_sources(df, budget=2.0).collect())
    assert not any(r.taken for r in mix_sources(df, budget=0.0).collect())


def test_reruns_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string, source string")
    runs = [sorted((r.doc_id, r.taken) for r in mix_sources(x).collect()) for x in (df, df.repartition(7), df.coalesce(1))]
    assert runs[0] == runs[1] == runs[2]


def test_mixture_is_sorted_and_repeats(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string, source string")
    taken = {r.doc_id: r.epochs for r in mix_sources(df).collect()}
    got = defaultdict(int)
    for r in mixture(df).collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in taken.items() if v}


def test_ties_nulls_empty_and_clashing_names(spark):
    rows = [(1, "a b c", "s", 7), (1, "a b c", "s", 7), (None, "x", None, 7), (2, None, "s", 7)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, taken int"))
    assert got.count() == 4 and dict(got.dtypes)["taken"] == "bigint"
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).count() == 0 and mixture(empty).count() == 0
    nothing = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mix_sources(nothing).collect()] == [0, 0]
