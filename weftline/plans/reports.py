"""Report queries by address: ``/report/monitor/<measure>``, ``/report/agent/<pattern>`` and ``/report/graph``."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 2016


def weekly_series(observations: DataFrame, name: str) -> DataFrame:
    """``name, timeseries``: the slots of a measure as JSON, in order; empty slots are left out."""
    rows = F.array_sort(F.collect_list(F.struct("timeslot", "timekey", "q", "expect", "var")))
    return observations.where(F.col("observable") == name).groupBy(F.col("observable").alias("name")).agg(F.to_json(rows).alias("timeseries"))


def promises(compliance: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """Promises whose handle matches somewhere, with the path and handle apart; ``keep`` names further columns."""
    cut = F.split("handle", ":")
    return compliance.where(F.col("handle").rlike(pattern)).select(*keep, F.array_join(F.slice(cut, F.lit(1), F.size(cut) - 1), ":").alias("namespacepath"), F.element_at(cut, -1).alias("handle"), "q", "expect", "var")


def dispatch(uri: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The report of an address; an unknown one is an error."""
    parts = [unquote(p) for p in uri.strip("/").split("/")]
    match parts:
        case ["report", "monitor"]:
            return tables["observations"].where("expect <> 0").select("observable").distinct()
        case ["report", "monitor", name, *_]:
            return weekly_series(tables["observations"], name)
        case ["report", "agent", *rest]:
            return promises(tables["compliance"], rest[0] if rest else "")
        case ["report", "graph"]:
            return tables["edges"]
    raise ValueError(f"no report at {uri}")
