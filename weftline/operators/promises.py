"""Measurements and bundles that a user declares: what to read out of which lines, and named steps over tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measurement:
    """A number read from the lines that match: the one group of ``extract``, folded over all of them.

    ``history``: ``sum``, ``count``, ``mean``, ``max`` or ``last`` (by ``order``).
    """

    name: str
    match: str
    extract: str
    history: str = "sum"
    order: str | None = None

    def value(self, line: Column) -> Column:
        return F.when(line.rlike(self.match), F.regexp_extract(line, self.extract, 1).try_cast("double"))

    def over(self, lines: DataFrame, column: str, *keys: str) -> DataFrame:
        """``keys, name, value``; keys without a matching line have a null."""
        x = self.value(F.col(column))
        folded = {"sum": F.sum(x), "count": F.count(x).cast("double"), "mean": F.avg(x), "max": F.max(x)}
        if self.history == "last":
            out = F.max(F.when(x.isNotNull(), F.struct(F.col(self.order), x.alias("x"))))["x"]
        else:
            out = folded[self.history]
        return lines.groupBy(*keys).agg(out.alias("value")).withColumn("name", F.lit(self.name))


def measured(lines: DataFrame, column: str, measurements: list[Measurement], *keys: str) -> DataFrame:
    """All measurements of the same lines in one pass: ``keys`` and a column for each."""
    found = lines
    for m in measurements:
        found = found.withColumn(f"_{m.name}", m.value(F.col(column)))
    folds = {"sum": F.sum, "count": lambda x: F.count(x).cast("double"), "mean": F.avg, "max": F.max}
    aggregated = [(F.max(F.when(F.col(f"_{m.name}").isNotNull(), F.struct(m.order, f"_{m.name}")))[f"_{m.name}"] if m.history == "last" else folds[m.history](F.col(f"_{m.name}"))).alias(m.name) for m in measurements]
    return found.groupBy(*keys).agg(*aggregated)


def bundle(*steps: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Steps one after the other as one; each takes the table and those of the given parameters that it names."""

    def run(table: DataFrame, **given) -> DataFrame:
        for step in steps:
            names = step.__code__.co_varnames[1 : step.__code__.co_argcount + step.__code__.co_kwonlyargcount]
            table = step(table, **{k: v for k, v in given.items() if k in names})
        return table

    return run
