"""Similar pairs of one table and clusters made from them, against plain loops; queries that take in whole tables."""

import random

from ledgerloom.operators import joins, mining
from ledgerloom.plans import catalog

DISTINCTIVE, RARE = ("fee", "cap", "wage"), ("lottery", "lawsuit")


def _same(a, b, at_least=0.6):
    common = a & b
    return bool(common) and (len(common) / len(a | b) >= at_least or (len(common & {*DISTINCTIVE, *RARE}) >= 2 and bool(common & set(RARE))))


def _rows(n=160, seed=2):
    rng = random.Random(seed)
    words = [*DISTINCTIVE, *RARE, *"abcdefghij"]
    return [(i, rng.choices(words, k=rng.randint(0, 7))) for i in range(n)]


def test_pairs_of_one_table_equal_brute_force(spark):
    rows = _rows()
    got = joins.similar_self_pairs(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", 0.6, DISTINCTIVE, RARE).collect()
    want = {(i, j): round(len({*a} & {*b}) / len({*a} | {*b}), 6) for i, a in rows for j, b in rows if i < j and _same({*a}, {*b})}
    assert len(got) == len(want) and {(r.a, r.b): r.jaccard for r in got} == want
    assert any(jaccard < 0.6 for jaccard in want.values()) and any(i % 2 == j % 2 for i, j in want)


def test_two_common_distinctive_tokens_need_a_rare_one(spark):
    rows = [(1, ["fee", "cap", "a", "b", "c"]), (2, ["fee", "cap", "d", "e", "f"]), (3, ["lottery", "cap", "g", "h", "i"]), (5, ["lottery", "cap", "j", "k", "l"]), (7, ["lottery", "g", "m", "n", "o"])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    assert [(r.a, r.b) for r in joins.similar_self_pairs(df, "k", "t", 0.6, DISTINCTIVE, RARE).collect()] == [(3, 5)]
    assert joins.similar_self_pairs(df, "k", "t", 0.6).count() == 0
    by = {r.k: r.seed for r in mining.cluster_stories(df.selectExpr("1 AS day", "*"), "day", "k", "t", [*RARE], distinctive=[*DISTINCTIVE]).collect()}
    assert by == {1: 1, 2: 2, 3: 3, 5: 3, 7: 7}


def test_clusters_from_pairs_equal_the_fold(spark):
    for seed in (3, 4):
        rows = _rows(120, seed)
        df = spark.createDataFrame(rows, "k long, t array<string>")
        pairs = joins.similar_self_pairs(df, "k", "t", 0.6, DISTINCTIVE, RARE)
        seeds, want = [], {}
        for k, own in rows:
            want[k] = next((s for s, theirs in seeds if _same({*own}, theirs)), k)
            if want[k] == k:
                seeds.append((k, {*own}))
        assert {r.k: r.seed for r in mining.cluster_pairs(df, "k", pairs).collect()} == want


def test_queries_take_in_whole_tables(spark, tmp_path):
    folder = str(tmp_path)
    parts = [(2, "blue ring", "SMALL", "Brand#1"), (4, "blue ring", "SMALL", "Brand#2"), (6, "red rod", "LARGE", "Brand#3"), (8, "hot gizmo", "PROMO", "Brand#3"), (9, "cold gizmo", "LARGE", "Brand#3")]
    spark.createDataFrame(parts, "p_partkey int, p_name string, p_type string, p_brand string").write.parquet(f"{folder}/part.parquet")
    events = [(i, i % 3, f"2024-01-{1 + i % 25:02d} 00:00:00") for i in (*range(900), 7000)]
    spark.createDataFrame(events, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "'view' AS event_type").write.parquet(f"{folder}/events.parquet")
    docs = [(i, t) for i, t in enumerate(["Visa fee rises in the spring\nbody", "Visa fee rises in spring\nother", "Lawsuit over the wage rule", "Court hears lawsuit, new wage table ahead", "", None])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    queries = catalog.registry().queries
    assert sorted((r.a, r.b) for r in queries["j16_similarity_self_pairs"](spark, folder).collect()) == [(2, 4), (8, 9)]
    assert {r.gen: r.n for r in queries["u1_union_all_shifted"](spark, folder).collect()} == {0: 901, 1: 901}
    assert sum(r.n for r in queries["j5_upsert_halves"](spark, folder).filter("status IN ('kept', 'added', 'same', 'conflict')").collect()) > 0
    assert sorted((r.doc_id, r.seed) for r in queries["d17_greedy_cluster"](spark, folder).collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5)]


def test_pairs_that_share_a_rare_word_are_not_moved(spark):
    rng = random.Random(7)
    rows = [(i, ["rare", *rng.sample([f"w{k}" for k in range(3000)], rng.randint(20, 40))]) for i in range(60)]
    rows += [(100 + i, [*t[: len(t) - i % 9], f"x{i}"]) for i, (_, t) in enumerate(rows[:30])]
    own = spark.createDataFrame(rows, "id long, t array<string>").selectExpr("id", "array_sort(array_distinct(t)) AS s")
    _, members, ranked = joins._distinct_sets(own)
    ids = {r.m: r.id for r in members.collect()}
    at = {i: {*t} for i, t in rows}
    for at_least in (0.3, 0.6, 0.9):
        want = {(i, j) for i in at for j in at if i < j and len(at[i] & at[j]) / len(at[i] | at[j]) >= at_least}
        pairs = lambda found: [tuple(sorted((ids[r.ma], ids[r.mb]))) for r in found.collect()]  # noqa: B023, E731
        made, kept = pairs(joins._possible(ranked, at_least)), pairs(joins._similar(ranked, at_least))
        assert sorted(kept) == sorted(want) and want <= {*made} and len(made) == len({*made})
        assert len(made) <= len(want) + 20  # all share a word


def test_class_pairs_and_members_are_all_pairs(spark):
    rows = [(i, t) for i, t in _rows(200, 5)] + [(1000 + i, ["fee", "lottery", "a"]) for i in range(40)]  # a set of many rows
    df = spark.createDataFrame(rows, "k long, t array<string>")
    got = joins.similar_class_pairs(df, "k", "t", 0.6, DISTINCTIVE, RARE).collect()
    first = {r.b: r.a for r in got if r.copy}
    linked = {(r.a, r.b): r.jaccard for r in got if not r.copy}
    assert len(got) == len(first) + len(linked) and not {*first} & {k for pair in linked for k in pair}
    sets = [(k, {*t}) for k, t in rows if t]
    heads = {}
    for k, s in sets:
        heads.setdefault(frozenset(s), k)
    assert first == {k: heads[frozenset(s)] for k, s in sets if heads[frozenset(s)] != k}
    want = {(i, j): round(len(a & b) / len(a | b), 6) for i, a in sets for j, b in sets if i < j and _same(a, b)}
    at = lambda k: first.get(k, k)
    back = {(i, j): 1.0 if at(i) == at(j) else linked[min(at(i), at(j)), max(at(i), at(j))] for i, _ in sets for j, _ in sets if i < j and (at(i) == at(j) or (min(at(i), at(j)), max(at(i), at(j))) in linked)}
    assert back == want and len(got) < len(want)


def test_copies_of_parts_are_not_made_into_all_pairs(spark, tmp_path):
    folder = str(tmp_path)
    parts = [(i, f"blue {'ring' if i % 2 else 'rod'}", "SMALL", "Brand#7") for i in range(300)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{folder}/part.parquet")
    got = catalog.registry().queries["j16_similarity_self_pairs"](spark, folder).collect()
    assert sorted((r.b, r.a) for r in got if r.copy) == [(i, i % 2) for i in range(2, 300)]
    assert [(r.a, r.b, r.jaccard) for r in got if not r.copy] == [(0, 1, 0.6)]


def test_classes_keep_the_pairs_of_different_sets(spark):
    rows = [(i, t) for i, t in _rows(200, 6)] + [(1000 + i, ["fee", "lottery", "a"]) for i in range(40)]  # a set of many rows
    got = joins.similar_classes(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", 0.6).collect()
    sets = [(k, {*t}) for k, t in rows if t]
    heads = {}
    for k, s in sets:
        heads.setdefault(frozenset(s), k)
    like = lambda a, b: len(a & b) / len(a | b)
    links = {k: sum(j != k and like(s, o) >= 0.6 for j, o in sets) for k, s in sets}
    want = [(k, heads[frozenset(s)], links[k], heads[frozenset(s)], 1.0) for k, s in sets]
    want += [(i, i, links[i], j, round(like(a, b), 6)) for a, i in heads.items() for b, j in heads.items() if i < j and like(a, b) >= 0.6]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > len(sets)


def test_parts_with_the_same_number_of_links_differ_by_their_pairs(spark, tmp_path):
    found = []
    for pairs in (((1, 2), (3, 4)), ((1, 3), (2, 4))):  # every part has one link in both tables
        folder = str(tmp_path / f"{pairs[0][1]}")
        parts = [(i, f"name{k} more{k} also{k} ring", "SMALL", f"Brand#{x}") for k, pair in enumerate(pairs) for x, i in enumerate(pair)]
        spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{folder}/part.parquet")
        got = catalog.registry().queries["j16_similarity_pairs"](spark, folder).collect()
        assert sorted((r.p_partkey, r.class_id, r.links) for r in got if r.similar_to == r.class_id) == [(i, i, 1) for i in (1, 2, 3, 4)]
        found.append({(r.class_id, r.similar_to): r.jaccard for r in got if r.similar_to != r.class_id})
    assert found == [{(1, 2): 0.714286, (3, 4): 0.714286}, {(1, 3): 0.714286, (2, 4): 0.714286}]
