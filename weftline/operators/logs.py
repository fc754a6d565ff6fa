"""What can be read out of log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_time(line: Column, year: Column | None = None) -> Column:
    """The first time stamp of the known forms, as a timestamp.

    ``year`` (a Column, else the current year) completes stamps like ``I0813 15:00:01``.
    """
    part = lambda p: F.regexp_extract(line, p, 1)
    read = lambda text, form: F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(form))
    year = (F.year(F.current_date()) if year is None else year).cast("string")
    short = part(r"^[IWEF](\d{4} \d\d:\d\d:\d\d)")
    seconds = part(r"(?:^|\s)t=(\d{9,11})(?:\D|$)")
    return F.coalesce(
        read(part(r"time=\"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)"), "yyyy-MM-dd'T'HH:mm:ss"),
        read(part(r"(?:^|\s)t=(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)"), "yyyy-MM-dd'T'HH:mm:ss"),
        F.timestamp_seconds(seconds.try_cast("long")),
        F.when(short != "", read(F.concat(year, short), "yyyyMMdd HH:mm:ss")),
        read(part(r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)"), "yyyy-MM-dd HH:mm:ss"),
        read(part(r"(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d)"), "yyyy/MM/dd HH:mm:ss"),
        read(part(r"(\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d) "), "dd/MMM/yyyy:HH:mm:ss"),
    )


def file_context(path: Column) -> Column:
    """``namespace, pod`` of a log file's name: ``default-pod.…``, else ``a-b-pod.…`` in the namespace ``a-b``."""
    name = F.element_at(F.split(path, "/"), -1)
    plain = name.startswith("default")
    pod = F.when(plain, F.regexp_extract(name, r"^default.([^.]*)", 1)).otherwise(F.regexp_extract(name, r"^[^-]*-[^-.]*-([^.]*)", 1))
    namespace = F.when(plain, "default").otherwise(F.regexp_extract(name, r"^([^-]*-[^-.]*)", 1))
    return F.struct(namespace.alias("namespace"), F.when(pod == "", "pod?").otherwise(pod).alias("pod"))


def braces(text: Column) -> Column:
    """How many braces a text opens more than it closes."""
    return (F.char_length(F.regexp_replace(text, "[^{]", "")) - F.char_length(F.regexp_replace(text, "[^}]", ""))).cast("long")


def stitched(lines: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Objects that run over several lines: ``key, first, text`` from the first brace to where braces balance.

    The depth is a running sum in a key (a file), so lines of different keys never meet.
    """
    w = W.partitionBy(*key).orderBy(order)
    depth = F.sum(braces(F.col(text))).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("_after", depth).withColumn("_before", F.coalesce(F.lag("_after").over(w), F.lit(0)))
    begins = (F.col("_before") <= 0) & F.col(text).contains("{")
    rows = rows.withColumn("_begin", begins).withColumn("_object", F.sum(F.col("_begin").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.where((F.col("_before") > 0) | F.col("_begin"))
    part = F.when(F.col("_begin"), F.regexp_extract(F.col(text), r"(?s)(\{.*)", 1)).otherwise(F.col(text))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), part.alias("part"))))
    return rows.groupBy(*key, "_object").agg(F.min(order).alias("first"), F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("text")).drop("_object")


def changed(objects: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Adds ``changed``: whether an object differs from the one before of its key."""
    w = W.partitionBy(*key).orderBy(order)
    return objects.withColumn("changed", ~F.col(text).eqNullSafe(F.lag(text).over(w)))


def message_concept(fragment: Column, *parts: Column) -> Column:
    """An event's name out of a message, with the addresses, paths and quotes it is about; null without any of these."""
    about = F.concat_ws(",", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(about != "", F.concat(F.lit("message event `"), fragment, F.lit("' concerning: "), about, F.lit(","), fragment))


def anomaly_event(names: Column, when: Column, namespace: Column, pod: Column) -> Column:
    """Tuples of an anomalous bucket: the event with its six aspects, its cluster and the members of that."""
    from .anomaly import cluster_name
    from .graph import EXPRESSES, _tuple, event_clue

    cluster = F.concat(F.lit("anomaly cluster "), cluster_name(names))
    event = F.concat(F.lit("event "), cluster)
    ctx = F.lit("log analysis")
    role = F.array(_tuple(event, EXPRESSES, "has the role of", F.lit("log anomaly"), "is a role fulfilled by", ctx), _tuple(event, EXPRESSES, "expresses an attribute", cluster, "is an attribute of", ctx))
    members = F.transform(names, lambda n: _tuple(cluster, EXPRESSES, "expresses an attribute", n, "is an attribute of", ctx))
    return F.concat(event_clue(F.lit("app"), event, when, namespace, F.lit("istio measurements"), pod), role, members)


IPV4 = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
URI = r"(/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*)"


def ipv4(line: Column) -> Column:
    return F.regexp_extract(line, IPV4, 1)


def without_addresses(line: Column) -> Column:
    return F.regexp_replace(line, IPV4, "")


def uris(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(URI), F.lit(1))


def message(line: Column) -> Column:
    """Letters, dots and colons with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, "[^A-Za-z.: ]", ""), " +", " "))


def fragments(line: Column) -> Column:
    """Quoted strings of a line."""
    return F.regexp_extract_all(line, F.lit('"([^"]*)"'), F.lit(1))


def items(body: Column) -> Column:
    """Quoted strings, else runs without blanks, commas and semicolons."""
    return F.regexp_extract_all(body, F.lit(r'("[^"]*"|[^\s,;]+)'), F.lit(1))


def counter_key(text: Column) -> Column:
    """From the first letter on, without commas and digits, canonical; null under twelve characters."""
    key = F.regexp_replace(F.regexp_replace(text, "^[^A-Za-z]+", ""), "[,0-9]", "")
    key = F.regexp_replace(key, "[^A-Za-z0-9]", "_")
    return F.when(F.char_length(key) >= 12, key)


def junk(text: Column) -> Column:
    """Text that tells nothing: hexadecimal, or at most twelve characters."""
    return text.rlike("^[0-9A-Fa-f_ ]*$") | (F.char_length(text) <= 12)


def buckets(logs: DataFrame, key: list[str], ts: str, timekey: str) -> DataFrame:
    """Runs of lines with one time key: ``bucket, timekey, lines, first, last`` per key."""
    w = W.partitionBy(*key).orderBy(ts, timekey)
    new = F.coalesce((F.col(timekey) != F.lag(timekey).over(w)).cast("int"), F.lit(0))
    numbered = logs.withColumn("_new", new).withColumn("bucket", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "bucket").agg(F.first(timekey).alias("timekey"), F.count("*").alias("lines"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def gaps(events: DataFrame, key: str, ts: str, limit: float) -> DataFrame:
    """Rows that come more than ``limit`` seconds after the one before, with that gap."""
    w = W.partitionBy(key).orderBy(ts)
    return events.withColumn("gap", F.col(ts) - F.lag(ts).over(w)).where(F.col("gap") > limit)
