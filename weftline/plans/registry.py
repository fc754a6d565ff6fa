"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers ``f(t)``, where ``t(name)`` reads a table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda x: table(spark, sf_dir, x))
        if sql:
            SQL[name] = sql
        return f

    return add


def columns(name: str, source: str, base, sql_base: str, key: str, **outputs: tuple[Callable[[], Column], str]) -> None:
    """A query that adds expressions to a base: per output, the Column and its SQL."""

    def run(spark, sf_dir):
        return base(table(spark, sf_dir, source)).select(key, *[c().alias(k) for k, (c, _) in outputs.items()])

    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, {', '.join(f'{s} AS {k}' for k, (_, s) in outputs.items())} FROM ({sql_base}) base"


def text_of(values: Column) -> Column:
    """A list as text, so that engines can be compared."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")
