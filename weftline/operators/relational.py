"""Counts, summaries, neighbours in order and memberships over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import full_match


def _window(keys: list[str], order: list):
    return W.partitionBy(*keys).orderBy(*order)


# --- joins and memberships ---


def lookup(rows: DataFrame, names: DataFrame, key: str, of: str) -> DataFrame:
    """Rows with the names of their ids; rows without one are left out."""
    return rows.join(names, F.col(key) == F.col(of))


def crossed(rows: DataFrame, values: list, alias: str) -> DataFrame:
    """Each row with each of a few values."""
    return rows.withColumn(alias, F.explode(F.array(*map(F.lit, values))))


def vanished(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys that were there before and are not now."""
    return before.select(key).join(now.select(key), key, "left_anti").distinct()


def zero_filled(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """``key, before, after``: how often a key is in either table, 0 where it is not."""
    a, b = before.groupBy(key).agg(F.count("*").alias("before")), now.groupBy(key).agg(F.count("*").alias("after"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return a.join(b, key, "full_outer").select(key, zero("before"), zero("after"))


def seen_since(rows: DataFrame, key: str, ts: str, since: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.max(ts).alias("last")).where(F.col("last") >= since).select(key)


def aged(rows: DataFrame, key: str, ts: str, since: Column) -> DataFrame:
    """Keys that were not seen since."""
    return vanished(rows, rows.where(F.col(ts) >= since), key)


# --- summaries ---


def bag_count(rows: DataFrame, item: str) -> DataFrame:
    return rows.groupBy(item).agg(F.count("*").alias("n"))


def bucket_sum(rows: DataFrame, bucket: Column, name: Column, value: str) -> DataFrame:
    """``timekey, name, total`` of a counter by bucket and canonical name."""
    return rows.groupBy(bucket.alias("timekey"), F.regexp_replace(name, "[^A-Za-z0-9_]", "_").alias("name")).agg(F.sum(value).alias("total"))


def envelope(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def compliance(rows: DataFrame, key: str, kept: Column, rank: Column) -> DataFrame:
    """``kept, worst``: the share of promises that were kept, and the worst outcome by rank."""
    return rows.groupBy(key).agg(F.avg(kept.cast("double")).alias("kept"), F.max(rank).alias("worst"))


def measurement(rows: DataFrame, key: str, line: str, matching: str, source: str, extract: str) -> DataFrame:
    """``total, matches``: what one group of a pattern gives in the lines that match."""
    found = rows.where(F.col(line).rlike(matching))
    return found.groupBy(key).agg(F.sum(F.regexp_extract(source, extract, 1).cast("long")).alias("total"), F.count("*").alias("matches"))


def log_summary(rows: DataFrame, seconds: Column, bucket: int = 300) -> DataFrame:
    return rows.agg(F.count("*").alias("lines"), (F.max(seconds) - F.min(seconds)).alias("duration"), F.countDistinct(F.floor(seconds / bucket)).alias("buckets"))


def mean_score(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The mean of a key as a whole number, halves away from zero.

    Values are summed as decimals as they are written, so a half is not decided by the order of the rows; where one
    is too large for that or no number, the key's sum is one of doubles.
    """
    exact = F.col(value).try_cast("decimal(38,18)")
    mean = F.when(F.count(exact) == F.count(value), F.round(F.try_avg(exact)))
    return rows.groupBy(key).agg(F.coalesce(mean.cast("long"), F.round(F.avg(value)).cast("long")).alias("score"))


def best_text(rows: DataFrame, key: str, phrase: str) -> DataFrame:
    """All phrases of a key in one, ``both a and b``."""
    names = F.array_sort(F.collect_set(phrase))
    return rows.groupBy(key).agg(F.concat(F.when(F.size(names) > 1, "both ").otherwise(""), F.array_join(names, " and ")).alias("best"))


def group_counts(rows: DataFrame, system: Column, user: str) -> DataFrame:
    return rows.agg(F.count_if(system).alias("system"), F.count_if(~system).alias("others"), F.countDistinct(user).alias("users"))


def ranges(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.format_string("%.2f .. %.2f", F.min(value), F.max(value)).alias("range"))


def measures(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Names whose mean is not 0."""
    return rows.groupBy(name).agg(F.avg(value).alias("_e")).where("_e <> 0").select(name)


def weekly_points(rows: DataFrame, slot: Column, value: str) -> DataFrame:
    return rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.avg(value).alias("q"))


def dense_slots(points: DataFrame, slots: int = 2016) -> DataFrame:
    """``slot, n`` of all slots, 0 where there is no point."""
    return points.sparkSession.range(slots).select(F.col("id").alias("slot")).join(points, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))


def count_matching(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.agg(F.count_if(full_match(F.col(column), pattern)).alias("n"))


def any_matches(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.agg(F.bool_or(full_match(F.col(column), pattern)).alias("found"))


# --- neighbours in order ---


def growth(rows: DataFrame, keys: list[str], order: list[str], value: str, alias: str = "growth") -> DataFrame:
    return rows.withColumn(alias, F.col(value) - F.lag(value).over(_window(keys, order)))


def last_change(rows: DataFrame, keys: list[str], order: list[str], state: str, at: Column, alias: str = "changed") -> DataFrame:
    """Adds when a key's state last changed; its first state counts as a change."""
    w = _window(keys, order)
    before = F.lag(state).over(w)
    out = rows.withColumn("_change", F.when(before.isNull() | (before != F.col(state)), at))
    return out.withColumn(alias, F.last("_change", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_change")


def relocations(rows: DataFrame, keys: list[str], order: list[str], place: str) -> DataFrame:
    """Rows whose place is another than the one before."""
    return rows.withColumn("_before", F.lag(place).over(_window(keys, order))).where(F.col("_before") != F.col(place)).drop("_before")


def moving_average(rows: DataFrame, keys: list[str], order: list[str], value: str, reach: int = 1, alias: str = "smooth") -> DataFrame:
    return rows.withColumn(alias, F.avg(value).over(_window(keys, order).rowsBetween(-reach, reach)))


def nth_row(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(_window(keys, order))).where(F.col("_n") == n).drop("_n")


def beam(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """At most so many rows of a key; the limit is taken per task before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(_window(keys, order))).where(F.col("_n") <= most).drop("_n")


def first_rows(rows: DataFrame, order: list, most: int) -> DataFrame:
    return rows.orderBy(*order).limit(most)


def places(rows: DataFrame, item: str) -> DataFrame:
    """``item, place`` by count, ties by name; over the counts, so few rows are ranked."""
    n = bag_count(rows, item)
    return n.select(item, F.row_number().over(W.orderBy(F.desc("n"), item)).alias("place"))


# --- peers ---


def peer_groups(rows: DataFrame, name: str, number: Column) -> DataFrame:
    """``name, n_peers, least`` of groups of neighbours, by the number of their group."""
    g = rows.select(name, number.alias("_g"))
    by = g.groupBy("_g").agg((F.count("*") - 1).alias("n_peers"), F.min(name).alias("least"))
    return g.join(by, "_g").select(name, "n_peers", "least")


def peer_leader(rows: DataFrame, name: str, number: Column, order: str) -> DataFrame:
    return rows.select(name, F.first(name).over(W.partitionBy(number).orderBy(order)).alias("leader"))
