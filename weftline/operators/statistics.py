"""Online statistics: ordered folds, first differences, rates, entropy and histograms.

A fold that forgets needs the end of a key's history only: what lies so far back that its
weight is below the precision of a double changes nothing. :func:`recent` takes that end,
with a limit per key and task before the shuffle, so no row holds a whole history and a
key with a third of all rows costs no more than any other. A fold that rounds at each step
(:func:`log_ewma`) has no such end and reads everything, one key's rows after the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(df: DataFrame, keys: list[str], order: list[str], value: str, alias: str = "q") -> DataFrame:
    """Per key, all values in order as an array; for folds that remember everything, over keys of bounded history."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["_v"]).alias(alias))


def horizon(kept: float, passes: int = 1) -> int:
    """How many values a fold that keeps this share of its state at each step depends on, for a double; a variance needs two passes."""
    return passes * math.ceil(-math.log(1e-18) / -math.log(kept)) + 1


def recent(df: DataFrame, keys: list[str], order: list[str], value: str, most: int, alias: str = "q") -> DataFrame:
    """Per key, the last ``most`` values in order as an array (999 at most, up to which the limit is taken before the shuffle)."""
    if most > 999:
        raise ValueError("a horizon of at most 999 values")
    w = W.partitionBy(*keys).orderBy(*map(F.desc, order))
    return ordered(df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most), keys, order, value, alias)


def ewma(values: Column, p: float) -> Column:
    """``expect, var`` after folding all values: the first sets ``expect``; later ones weigh ``p``, their squared distance from the old mean likewise."""
    start = F.struct(F.lit(None).cast("double").alias("expect"), F.lit(0.0).alias("var"))

    def step(s, q):
        old = s["expect"]
        return F.struct(F.when(old.isNull(), q).otherwise(p * q + (1 - p) * old).alias("expect"), F.when(old.isNull(), 0.0).otherwise(p * (q - old) * (q - old) + (1 - p) * s["var"]).alias("var"))

    return F.aggregate(values, start, step)


def two_regime_ewma(values: Column, young: int, p_young: float = 0.7, p_old: float = 0.3, seen: Column | None = None) -> Column:
    """An average that forgets faster over its first ``young`` values; negative values count as 0. ``seen``: how many came before the array's."""
    seen = F.lit(0) if seen is None else seen
    indexed = F.transform(values, lambda v, i: F.struct(F.greatest(v, F.lit(0.0)).alias("v"), F.when(i + seen < young, p_young).otherwise(p_old).alias("p")))
    return F.aggregate(indexed, F.lit(0.0), lambda s, x: x["p"] * x["v"] + (1 - x["p"]) * s)


def log_ewma(samples: DataFrame, keys: list[str], order: list[str], value: str, forget: float = 0.55) -> DataFrame:
    """``keys, av, var`` of the log pipeline: from zero, each rounded to two decimals, the variance about the new mean.

    Rounding at each step can keep a difference for ever, so this fold reads the whole history: rows come sorted
    by key and order, and only the state of one key is held. A null leaves its key without a result.
    """
    new = round(1 - forget, 12)

    def run(batches):
        import math

        import pyarrow as pa

        def rounded(x):
            hundreds = x * 100
            if not math.isfinite(hundreds):
                return x
            whole = math.trunc(hundreds)
            return (whole + math.copysign(1, x) if abs(hundreds - whole) >= 0.5 else whole) / 100

        def step(state, q):
            if q is None or state[0] is None:
                return None, None
            av = rounded(forget * state[0] + new * q)
            return av, rounded(forget * state[1] + new * (q - av) * (q - av))

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), [*kinds, pa.float64(), pa.float64()], strict=True)], [*keys, "av", "var"])

        key = state = kinds = None
        for batch in batches:
            kinds = [f.type for f in batch.schema][:-1]
            *names, values = (c.to_pylist() for c in batch.columns)
            done = []
            for k, q in zip(zip(*names, strict=True), values, strict=True):
                if k != key:
                    if state:
                        done.append((*key, *state))
                    key, state = k, (0.0, 0.0)
                state = step(state, q)
            if done:
                yield rows(done)
        if state:
            yield rows([(*key, *state)])

    fields = [*(samples.schema[k] for k in keys), T.StructField("av", T.DoubleType()), T.StructField("var", T.DoubleType())]
    near = samples.select(*keys, *order, F.col(value).cast("double").alias("_v")).repartition(*keys).sortWithinPartitions(*keys, *map(F.asc_nulls_last, order))
    return near.select(*keys, "_v").mapInArrow(run, T.StructType(fields))


def half_up(value: Column, places: int) -> Column:
    """A double to decimal places as SQL rounds it: halves of the multiple as computed, not of the number as written, away from zero."""
    return F.round(value * 10.0**places) / 10.0**places


def weekly_model(samples: DataFrame, p: float = 0.7) -> DataFrame:
    """``timekey, observable, n, expect, var`` of ``timekey, observable, ts, value``: one fold per slot of the week."""
    keys = ["timekey", "observable"]
    folded = recent(samples, keys, ["ts"], "value", horizon(1 - p, 2)).withColumn("s", ewma(F.col("q"), p))
    counts = samples.groupBy(*keys).agg(F.count("*").alias("n"))
    return folded.join(counts, keys).select(*keys, "n", F.col("s.expect").alias("expect"), F.col("s.var").alias("var"))


def differences(samples: DataFrame, key: str, order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Adds ``dq``, the difference from the sample before, and ``last_change``, the order value of the last change.

    Few keys give few tasks. With ``bucket``, a column that grows with the order (a day, say), rows are dealt
    out by key and bucket, and only the last row of each bucket is carried to the next.
    """
    if bucket is None:
        w = W.partitionBy(key).orderBy(*order)
        out = samples.withColumn("dq", F.col(value) - F.lag(value).over(w))
        changed = F.when(F.coalesce(F.col("dq"), F.lit(1.0)) != 0, F.col(order[0]))
        return out.withColumn("last_change", F.last(changed, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = samples.withColumn("_b", bucket)
    w = W.partitionBy(key, "_b").orderBy(*order)
    ends = own.groupBy(key, "_b").agg(F.max(F.struct(*order, value))[value].alias("_end"))
    carried = ends.withColumn("_carry", F.lag("_end").over(W.partitionBy(key).orderBy("_b"))).drop("_end")
    inner = own.withColumn("_first", F.row_number().over(w) == 1).withColumn("_lag", F.lag(value).over(w))
    out = inner.join(carried, [key, "_b"]).withColumn("dq", F.col(value) - F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
    changed = F.when(F.coalesce(F.col("dq"), F.lit(1.0)) != 0, F.col(order[0]))
    out = out.withColumn("_change", F.last(changed, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = out.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.max("_change").alias("_at"))
    before = last.withColumn("_before", F.last("_at", ignorenulls=True).over(W.partitionBy("_k").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))).drop("_at")
    out = out.join(before, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")))
    return out.select(*samples.columns, "dq", F.coalesce("_change", "_before").alias("last_change"))


def rates(counters: DataFrame, key: str, ts: str, value: str, wrap: int = 2147483647) -> DataFrame:
    """Adds ``rate`` of a cumulative counter per second; a smaller value has wrapped; -1 for a first row or no time between."""
    w = W.partitionBy(key).orderBy(ts, value)
    before, then = F.lag(value).over(w), F.lag(ts).over(w)
    grown = F.when(F.col(value) < before, wrap - before + F.col(value)).otherwise(F.col(value) - before)
    gap = F.col(ts) - then
    return counters.withColumn("rate", F.when(then.isNull() | (gap == 0), -1.0).otherwise(grown / gap))


def entropy(df: DataFrame, group: str, item: str) -> DataFrame:
    """``group, entropy, class``: normalised Shannon entropy of items; 0 for fewer than two; low below 0.2, high above 0.9."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("c"))
    totals = counts.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log("c")).alias("s"))
    value = F.when(F.col("k") < 2, 0.0).otherwise((F.log("n") - F.col("s") / F.col("n")) / F.log("k"))
    return totals.select(group, value.alias("entropy")).withColumn("class", F.when(F.col("entropy") < 0.2, "low").when(F.col("entropy") > 0.9, "high").otherwise("medium"))


def histogram(samples: DataFrame, observable: str, day: str, value: str, expect: str, maxvar: str, grains: int = 64) -> DataFrame:
    """``observable, day, grain, count``: distance from the mean in deviations over ``grains`` cells, ends clamped."""
    distance = (F.col(value) - F.col(expect)) / (1 + F.sqrt(F.col(maxvar)))
    grain = F.least(F.greatest(F.floor(grains * (0.5 + distance / 10)), F.lit(0)), F.lit(grains - 1))
    return samples.groupBy(observable, day, grain.cast("long").alias("grain")).agg(F.count("*").alias("count"))


def smoothed(hist: DataFrame, observable: str, day: str) -> DataFrame:
    w = W.partitionBy(observable, day).orderBy("grain").rowsBetween(-1, 1)
    return hist.withColumn("smooth", F.avg("count").over(w))


def normalised(hist: DataFrame, observable: str) -> DataFrame:
    """Adds ``level``: counts scaled so that the largest of an observable is 1000."""
    largest = hist.groupBy(observable).agg(F.max("count").alias("largest"))
    return hist.join(largest, observable).withColumn("level", 1000 * F.col("count") / F.greatest(F.lit(1), F.col("largest"))).drop("largest")


def leap_scores(samples: DataFrame, key: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """Adds ``chi``: how far a sample's ``n``-fold lies from the sum of the ``n`` before it; 0 until they are there."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-n, -1)
    total, count = F.sum(value).over(w), F.count(value).over(w)
    d = n * (n + 1) * total / n
    gap = total - n * F.col(value)
    return samples.withColumn("chi", F.when((count < n) | (d < 0.001), 0.0).otherwise(F.sqrt(gap * gap / d)))


def last_seen(contacts: DataFrame, direction: str, host: str, ts: str, p: float = 0.4) -> DataFrame:
    """``direction, host, last, n, average`` of contacts at ``ts`` (seconds): the average time between contacts.

    The first contact has an average of 0, and each later gap weighs ``p``.
    """
    keys = [direction, host]
    folded = recent(contacts, keys, [ts], ts, horizon(1 - p) + 1).join(contacts.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    gaps = F.transform(F.slice(F.col("q"), F.lit(2), F.greatest(F.size("q") - 1, F.lit(0))), lambda x, i: x - F.get(F.col("q"), i))
    average = F.aggregate(gaps, F.lit(0.0), lambda s, x: p * x + (1 - p) * s)
    return folded.select(direction, host, F.array_max("q").cast("long").alias("last"), "n", average.alias("average"))


def admitted(runs: DataFrame, keys: list[str], ts: str, ifelapsed: int) -> DataFrame:
    """``keys, ts`` of runs that a rate limit lets through: those at least ``ifelapsed`` whole minutes after the last that was let through."""
    folded = ordered(runs, keys, [ts], ts)
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("taken"))

    def step(s, x):
        free = s["last"].isNull() | (F.floor((x - s["last"]) / 60) >= ifelapsed)
        return F.when(free, F.struct(x.alias("last"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s)

    return folded.select(*keys, F.explode(F.aggregate("q", start, step, lambda s: s["taken"])).alias(ts)).withColumn(ts, F.col(ts).cast("long"))


def persistent(classes: DataFrame, keys: list[str], ts: str, ttl: int, policy: str = "reset") -> DataFrame:
    """``keys, begin, until`` of the spans in which a class is defined, from the times (seconds) at which it was set.

    ``reset``: each setting starts the time to live anew; ``preserve``: a class that is defined keeps its end.
    """
    if policy == "preserve":
        folded = ordered(classes, keys, [ts], ts)
        start = F.struct(F.lit(None).cast("double").alias("until"), F.array().cast("array<double>").alias("taken"))
        step = lambda s, x: F.when(s["until"].isNull() | (x >= s["until"]), F.struct((x + ttl).alias("until"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s)
        begun = folded.select(*keys, F.explode(F.aggregate("q", start, step, lambda s: s["taken"])).alias("begin")).withColumn("begin", F.col("begin").cast("long"))
        return begun.withColumn("until", F.col("begin") + ttl)
    w = W.partitionBy(*keys).orderBy(ts)
    before = F.lag(ts).over(w)
    rows = classes.select(*keys, ts).withColumn("_new", F.when(before.isNull() | (F.col(ts) >= before + ttl), 1).otherwise(0))
    rows = rows.withColumn("_span", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_span").agg(F.min(ts).alias("begin"), (F.max(ts) + ttl).alias("until")).drop("_span")
