"""Exact quantiles against sorted lists: one group of all rows, hot values, many ranges, doubles, nulls."""

import random
import statistics

import numpy as np
import pytest

from ledgerloom.operators.aggregates import exact_median, exact_quantiles


@pytest.mark.parametrize("range_values", [200_000, 7])
def test_quantiles_by_group(spark, range_values):
    rng = random.Random(1)
    rows = [("hot", rng.choice([5.0, 5.0, 5.0, rng.uniform(-100, 100)])) for _ in range(900)] + [("few", v) for v in (3.5, None, -1.0, 8.25)] + [("one", 2.0), ("none", None)]
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {(r.g, r.share): r.quantile for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, range_values).collect()}
    want = {(g, s): float(np.quantile([v for k, v in rows if k == g and v is not None], s)) for g in ("hot", "few", "one") for s in shares}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_one_group_of_all_rows_lies_in_many_ranges(spark):
    values = spark.range(20_001).selectExpr("id * 7919 % 20011 AS v")
    got = exact_quantiles(values, [], "v", [0.5], 500)
    assert got.columns == ["share", "quantile"]
    assert got.first().quantile == statistics.median(k * 7919 % 20011 for k in range(20_001))
    assert exact_quantiles(values.limit(0), [], "v", [0.5]).count() == 0


def test_medians_round_half_to_even_without_negative_values(spark):
    rows = [("a", 1), ("a", 2), ("a", -5), ("b", 2), ("b", 3), ("b", None), ("c", -1), ("d", 7)]
    got = {r.g: (r.n, r.median) for r in exact_median(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    assert got == {"a": (3, 2), "b": (3, 2), "d": (1, 7)}
