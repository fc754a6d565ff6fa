"""Aggregates whose result may not depend on the order of rows."""

import functools
import operator

from weftline.operators import relational


def test_mean_score_of_an_exact_half(spark):
    values = [6.15, 0.29, 8.24, 2.36, 6.51, 3.45]  # 27 as written, less as doubles added in this order
    assert functools.reduce(operator.add, values) / 6 < 4.5
    down = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in values[::-1]] + [("c", -v) for v in values], "k string, v double").coalesce(1)
    assert {tuple(r) for r in relational.mean_score(down, "k", "v").collect()} == {("a", 5), ("b", 5), ("c", -5)}


def test_mean_score_beyond_decimals(spark):
    rows = [("large", 9e18)] * 12 + [("null", None), ("some", None), ("some", 2.5), ("tiny", 1e-30), ("tiny", 1.0)]
    found = relational.mean_score(spark.createDataFrame(rows, "k string, v double"), "k", "v")
    assert {tuple(r) for r in found.collect()} == {("large", 9 * 10**18), ("null", None), ("some", 3), ("tiny", 1)}
