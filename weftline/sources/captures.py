"""Captured command output: process tables of fixed columns and socket lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def process_table(lines: DataFrame, header: str, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of a process listing by the columns of its header; the last field runs to the line's end.

    Numbers are right-aligned under their titles, so a field goes from the end of the
    title before to the end of its own.
    """
    names = header.split()
    ends, at = [], 0
    for n in names:
        at = header.index(n, at) + len(n)
        ends.append(at)
    starts = [0, *ends[:-1]]
    line = F.col(column)
    cells = [F.trim(F.substring(line, a + 1, (b - a) if k < len(names) - 1 else (1 << 31) - 1 - a)).alias(n.lower().lstrip("%")) for k, (n, a, b) in enumerate(zip(names, starts, ends, strict=True))]
    return lines.where((F.trim(line) != "") & (line != header)).select(*keep, *cells)


def socket_counts(lines: DataFrame, services: dict[int, str], column: str = "value") -> DataFrame:
    """``service, direction, n`` of established connections; a local port is incoming, a remote one outgoing."""
    fields = F.split(F.trim(F.col(column)), r"\s+")
    port = lambda i: F.regexp_extract(F.get(fields, i), r"[:.](\d+)$", 1).try_cast("int")
    rows = lines.where(F.col(column).rlike(r"^(tcp|udp).*ESTABLISHED")).select(port(3).alias("local"), port(4).alias("remote"))
    known = F.create_map(*[F.lit(x) for kv in services.items() for x in kv])
    sides = F.explode(F.array(F.struct(F.try_element_at(known, F.col("local")).alias("service"), F.lit("in").alias("direction")), F.struct(F.try_element_at(known, F.col("remote")).alias("service"), F.lit("out").alias("direction"))))
    return rows.select(sides.alias("x")).where("x.service is not null").groupBy("x.service", "x.direction").agg(F.count("*").alias("n"))


def selected(processes: DataFrame, command: str | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows whose whole command matches and whose numbers lie in the ranges."""
    test: Column = F.lit(True)
    if command:
        test = test & F.col("command").rlike(rf"\A(?:{command})\z")
    for name, (low, high) in (ranges or {}).items():
        test = test & F.col(name).try_cast("double").between(low, high)
    return processes.where(test)
