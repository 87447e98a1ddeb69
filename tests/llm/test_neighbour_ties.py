import random

import pytest

from ledgerloom.llm.neighbours import nearest_neighbours


def _ids(spark, rows, asked, k=5):
    schema = "vec_id long, embedding array<double>"
    got = nearest_neighbours(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), k).collect()
    return [r.vec_id for r in sorted(got, key=lambda r: (r.query_id, r.rank))]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_tied_vectors_go_to_the_smaller_ids(spark, seed):
    ids = list(range(1, 61))
    random.Random(seed).shuffle(ids)
    multiples = [(i, [2.0**e, 2.0**e]) for e, i in enumerate(ids)]
    assert _ids(spark, multiples, [(100, [1.0, 1.0])]) == [1, 2, 3, 4, 5]
    one_hot = [(i, [float(p == e) for p in range(60)]) for e, i in enumerate(ids)]
    query = (ids[0], one_hot[0][1])
    assert _ids(spark, one_hot, [query]) == [i for i in range(1, 61) if i != ids[0]][:5]


def test_own_rows_repeated_often_do_not_hide_the_others(spark):
    own = [(1, [1.0, 0.0])] * 9 + [(1, [1.0 + e, 0.1]) for e in range(12)]
    assert _ids(spark, own + [(7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0])], [(1, [1.0, 0.0])]) == [7, 8, 9]


def test_a_repeated_query_row_has_one_ranking(spark):
    rows = [(i, [1.0, 0.1 * i]) for i in range(20)]
    assert _ids(spark, rows, [rows[0], rows[0]]) == [1, 2, 3, 4, 5]


def test_thirty_scaled_copies_go_to_the_smallest_ids(spark):
    base = [0.3, -0.7, 0.2, 0.9]
    rows = [(0, base)] + [(i, [x * 2.0 ** (40 - i) for x in base]) for i in range(1, 31)] + [(50 + i, [1.0, float(i), 0.0, 0.0]) for i in range(200)]
    assert _ids(spark, rows, rows[:1]) == [1, 2, 3, 4, 5]


def test_a_row_that_is_repeated_very_often(spark):
    rows = [(5, [1.0, 2.0])] * 400 + [(i, [1.0, 2.0]) for i in range(6, 300)] + [(1, [2.0, 1.0]), (2, [0.0, 1.0])]
    assert _ids(spark, rows, [(5, [1.0, 2.0])]) == [6, 7, 8, 9, 10]
    assert _ids(spark, rows, [(2, [0.0, 1.0])]) == [5, 5, 5, 5, 5]


def test_other_columns_may_have_any_name(spark):
    schema = "vec_id long, embedding array<float>, id int, v string, n int, score int, rank int, cell int"
    rows = [(i, [1.0, 0.1 * i], 1, "x", 2, 3, 4, 5) for i in range(8)]
    df = spark.createDataFrame(rows, schema)
    got = nearest_neighbours(df, df.filter("vec_id = 3"), 2).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(3, 1, 4), (3, 2, 2)]
