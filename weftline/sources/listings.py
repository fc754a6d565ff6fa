"""Cluster listings: fixed tables and descriptions in sections, and the lines of graph and history files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def listed(lines: DataFrame, names: list[str], column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of a listing between runs of blanks, by the names of its columns; its heading is left out."""
    parts = F.split(F.trim(F.col(column)), r"\s{1,}")
    rows = lines.where((F.trim(F.col(column)) != "") & ~F.col(column).startswith(names[0].upper()))
    return rows.select(*keep, *[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def sections(lines: DataFrame, key: list[str], order: str, column: str = "value") -> DataFrame:
    """``section, name, value`` of a description: a heading without indentation names the section of the lines below it."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    line = F.col(column)
    heading = F.when(line.rlike(r"^\S[^:]*:\s*$"), F.regexp_extract(line, "^([^:]*):", 1)).when(line.rlike(r"^\S"), "")
    rows = lines.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where(line.contains(":") & ~line.rlike(r"^\S[^:]*:\s*$"))
    cut = F.split(F.trim(line), r":\s*", 2)
    return rows.select(*key, order, "section", cut[0].alias("name"), F.trim(F.get(cut, 1)).alias("value"))


def history_line(ts: Column, value: Column) -> Column:
    """A line of a measurement's history: date, epoch seconds, value."""
    return F.concat_ws(",", F.date_format(ts, "EEE MMM d HH:mm:ss yyyy"), F.unix_timestamp(ts.cast("timestamp")).cast("string"), F.format_string("%.4f", value.cast("double")))


def append_history(samples: DataFrame, path: str, ts: str = "ts", value: str = "value") -> None:
    samples.select(history_line(F.col(ts), F.col(value)).alias("line")).write.mode("append").text(path)


def graph_lines(slot: Column, q: Column, expect: Column, var: Column) -> dict[str, Column]:
    """The lines of the graph files of a measure, by their endings."""
    number = lambda x: F.format_string("%.4f", x.cast("double"))
    at = slot.cast("string")
    return {"q": F.concat_ws(" ", at, number(q)), "E-sigma": F.concat_ws(" ", at, number(expect), number(F.sqrt(var))), "mag": F.concat_ws(" ", at, number(expect))}


def write_graphs(series: DataFrame, path: str) -> None:
    """One folder for each ending of ``slot, observable, q, expect, var``."""
    for ending, line in graph_lines(*map(F.col, ("slot", "q", "expect", "var"))).items():
        series.select("observable", line.alias("value")).write.mode("overwrite").partitionBy("observable").text(f"{path}/{ending}")


def write_distribution(histogram: DataFrame, path: str) -> None:
    """``grain count`` lines of each observable and day."""
    histogram.select("observable", F.concat_ws(" ", F.col("grain").cast("string"), F.col("count").cast("string")).alias("value")).write.mode("overwrite").partitionBy("observable").text(f"{path}/distr")
