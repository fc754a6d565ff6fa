"""The fold of the log pipeline against a plain loop over whole histories."""

import math
import random

from weftline.operators import statistics


def rounded(x):
    return math.copysign(math.floor(abs(x * 100)) + (abs(x * 100) - math.floor(abs(x * 100)) >= 0.5), x) / 100


def fold(values):
    av = var = 0.0
    for q in values:
        av = rounded(0.55 * av + 0.45 * q)
        var = rounded(0.55 * var + 0.45 * (q - av) * (q - av))
    return av, var


def test_whole_history_and_rounding(spark):
    draw = random.Random(3)
    keys = {f"k{i}": [round(draw.expovariate(0.02) - 20, 2) for _ in range(draw.randint(1, 40))] for i in range(300)}
    keys["held"] = [100.0] + [5.05] * 700  # stays a hundredth above its values, where a start from zero stays below
    rows = [(k, i, q) for k, x in keys.items() for i, q in enumerate(x)]
    draw.shuffle(rows)
    found = statistics.log_ewma(spark.createDataFrame(rows, "k string, i int, q double"), ["k"], ["i"], "q")
    assert {r.k: (r.av, r.var) for r in found.collect()} == {k: fold(x) for k, x in keys.items()}
    assert fold(keys["held"])[0] == 5.06


def test_two_keys_nulls_and_no_rows(spark):
    rows = [("a", 1, 1, 2.0), ("a", 1, 2, 4.0), ("a", 2, 1, None), ("a", 2, 2, 4.0), ("b", 1, 1, 0.0)]
    df = spark.createDataFrame(rows, "k string, l long, i int, q double")
    found = statistics.log_ewma(df, ["k", "l"], ["i"], "q")
    assert {tuple(r) for r in found.collect()} == {("a", 1, *fold([2.0, 4.0])), ("a", 2, None, None), ("b", 1, 0.0, 0.0)}
    assert statistics.log_ewma(df.where("false"), ["k", "l"], ["i"], "q").collect() == []


def test_half_up(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (-0.25,), (None,)], "x double")
    assert [r[0] for r in df.select(statistics.half_up(df["x"], 2)).collect()] == [1.0, 0.28, -0.25, None]
