"""Classes of values against what was learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def situation(name: Column, value: Column, expect: Column, sigma: Column) -> Column:
    """``<name>_high|_low|_normal`` with ``_anomaly`` beyond three deviations (times the root of two) and ``_normal`` within one."""
    delta = value - expect
    dev = F.sqrt(delta * delta / (1 + sigma * sigma))
    side = F.when(delta > 0, "_high").when(delta < 0, "_low").otherwise("_normal")
    return F.concat(name, side, F.when(dev > 3 * 2**0.5, "_anomaly").when(dev <= 2**0.5, "_normal").otherwise(""))


# Above the first a value is not credible, above the second it is absurd; steps below the third are noise.
NOT_CREDIBLE, ABSURD, NOISE = 1e6, 4e6, 6.0


def reject(value: Column, average: Column, variance: Column, chance: Column | None = None) -> Column:
    """The value that is learned.

    With no average yet, any value; absurd ones give 0, those that are not credible the
    average, and small steps are taken. Beyond four deviations the value is taken, or,
    where ``chance`` (a draw from 0 to 1) is given and is 0.7 or more, two deviations.
    """
    dev = F.sqrt(variance)
    cut = average + F.when(value > average, 2.0).otherwise(-2.0) * dev
    far = (F.abs(value - average) > 4 * dev) & (chance >= 0.7) if chance is not None else F.lit(False)
    return F.when(average == 0, value).when(value > ABSURD, 0.0).when(value > NOT_CREDIBLE, average).when(F.abs(value - average) < NOISE, value).when(far, cut).otherwise(value)


def published(name: Column, value: Column, average: Column, deviation: Column, whole: bool = False) -> Column:
    """``value_x``, ``av_x`` and ``dev_x`` as text, with two decimals or, for named events, none."""
    form = "%.0f" if whole else "%.2f"
    return F.map_from_arrays(F.transform(F.array(*map(F.lit, ("value_", "av_", "dev_"))), lambda p: F.concat(p, name)), F.array(*[F.format_string(form, x.cast("double")) for x in (value, average, deviation)]))


def spike(name: Column, chi: Column, limit: float, value: Column, average: Column) -> Column:
    """``spike_x_high`` or ``_low`` where the leap score passes its limit."""
    return F.when(chi > limit, F.concat(F.lit("spike_"), name, F.when(value > average, "_high").otherwise("_low")))


def entropy_class(value: Column) -> Column:
    return F.when(value < 0.2, "low").when(value > 0.9, "high").otherwise("medium")


def clock_jump(now: Column, before: Column, cycle: int) -> Column:
    """A step back, or one of more than two cycles ahead."""
    return F.when(now < before, "clock_jumped_backwards_event").when(now > before + 2 * cycle, "clock_jumped_forwards_event")


def cluster_name(members: Column, most: int = 63) -> Column:
    """A short name of a list of names: their first letters, then their second ones and so on, without underscores and repeats."""
    letters = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(62)), lambda i: F.transform(members, lambda m: F.substr(m, i, F.lit(1)))))
    letters = F.filter(letters, lambda x: (x != "") & (x != "_"))
    return F.left(F.array_join(F.filter(letters, lambda x, i: (i == 0) | (x != F.get(letters, i - 1))), ""), F.lit(most))


def syndromes(changes: DataFrame, key: str) -> DataFrame:
    """``key, dimension, background, hypothesis`` of ``key, name, change, syndrome``.

    The dimension counts symptoms that appeared or vanished, the background what stayed.
    Where both performance and process symptoms are there, workload may explain performance.
    """
    open_ = F.col("change") != "="
    has = lambda kind: F.max(open_ & (F.col("syndrome") == kind))
    out = changes.groupBy(key).agg(F.count_if(open_).alias("dimension"), F.count_if(~open_).alias("background"), (has("performance") & has("process")).alias("hypothesis"))
    return out


def learned_fold(values: Column, forget: float = 0.5) -> Column:
    """``av, var, class`` after an ordered list of values, the learner that starts from half its first value.

    The first value sets the mean to its share and the variance to half of that; each
    later one is judged by three deviations (0.1 at least) and then learned.
    """
    keep = lambda x: F.greatest(x, F.lit(0.0))
    start = F.struct(F.lit(None).cast("double").alias("av"), F.lit(0.1).alias("var"), F.lit("").alias("class"))

    def step(s, q):
        old, var = s["av"], F.when(s["var"] == 0, 0.5).otherwise(s["var"])
        band = 3 * F.greatest(F.sqrt(var), F.lit(0.1))
        judged = F.when(old.isNull(), "").when(q > old + band, "high_anomaly").when(q < old - band, "low_anomaly").otherwise("")
        av = F.when(old.isNull(), keep((1 - forget) * q)).otherwise(keep((1 - forget) * q + forget * old))
        new = F.when(old.isNull(), keep((1 - forget) * q / 2)).otherwise(keep((1 - forget) * (q - old) * (q - old) + forget * var))
        return F.struct(av.alias("av"), new.alias("var"), judged.alias("class"))

    return F.aggregate(values, start, step)


def process_class(name: Column, value: Column, average: Column, variance: Column) -> Column:
    band = 3 * F.greatest(F.lit(0.1), F.sqrt(F.when(variance == 0, 0.5).otherwise(variance)))
    return F.when(value > average + band, F.concat(name, F.lit("_high_anomaly"))).when(value < average - band, F.concat(name, F.lit("_low_anomaly")))


def significant(expect: Column, variance: Column) -> Column:
    """Whether the mean stands out of its noise by four deviations."""
    return expect >= 4 * F.sqrt(variance)


def log_class(name: Column, q: Column, av: Column, var: Column, gap: Column) -> Column:
    """``high_x`` or ``low_x`` beyond three deviations, else ``rare_x`` for the first of its kind or one after more than a day."""
    band = 3 * F.sqrt(var)
    rare = gap.isNull() | (gap > 86400)
    return F.when(q > av + band, F.concat(F.lit("high_"), name)).when(q < av - band, F.concat(F.lit("low_"), name)).when(rare, F.concat(F.lit("rare_"), name))


# Fixed values below: the prefixes of names that tell process and security symptoms.
def state_changes(before: DataFrame, now: DataFrame, item: str = "name") -> DataFrame:
    """``+`` for items that appeared, ``-`` for those that vanished and ``=`` for those in both, with their kind of syndrome."""
    a = before.select(item).distinct()
    b = now.select(item).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), item, "full_outer")
    sign = F.when(F.col("_a").isNull(), "+").when(F.col("_b").isNull(), "-").otherwise("=")
    n = F.col(item)
    kind = F.when(n.startswith("JOB"), "process").when(n.startswith("USER") & n.contains("sudo"), "security").when(n.rlike("^(4_port|6_port|ipv4|ipv6)"), "security").otherwise("performance")
    return both.select(n, sign.alias("change"), kind.alias("syndrome"))
