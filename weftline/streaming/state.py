"""Keyed state over streams: last-seen registry, counter rates, rate limits, classes with a time to live, changes of state lists.

Each has a batch twin over ordered rows in ``operators.statistics`` or ``operators.anomaly``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WEEK_MS = 7 * 86_400_000


def _keyed(stream: DataFrame, keys: list[str], step: Callable, output: str, state: str, ttl_ms: int) -> DataFrame:
    """Applies ``step(key, rows in order of ts, state or None) -> (rows out, state)`` to each key; state without rows for ``ttl_ms`` goes."""

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out, new = step(key, rows, held.get if held.exists else None)
        held.update(new)
        held.setTimeoutDuration(ttl_ms)
        if len(out):
            yield out

    return stream.groupBy(*keys).applyInPandasWithState(run, output, state, "update", GroupStateTimeout.ProcessingTimeTimeout)


def last_seen(contacts: DataFrame, p: float = 0.4, ttl_ms: int = WEEK_MS) -> DataFrame:
    """``direction, host, last, n, average`` of a stream of ``direction, host, ts`` (seconds)."""

    def step(key, rows, state):
        last, n, average = state or (None, 0, 0.0)
        for ts in rows["ts"]:
            average = p * (ts - last) + (1 - p) * average if n else 0.0
            last, n = int(ts), n + 1
        return pd.DataFrame({"direction": [key[0]], "host": [key[1]], "last": [last], "n": [n], "average": [average]}), (last, n, float(average))

    return _keyed(contacts, ["direction", "host"], step, "direction string, host string, last long, n long, average double", "last long, n long, average double", ttl_ms)


def seen_within(registry: DataFrame, now: int, horizon: int) -> DataFrame:
    """Hosts of a registry that were seen in the last ``horizon`` seconds."""
    return registry.where(F.col("last") >= now - horizon)


def rates(counters: DataFrame, wrap: int = 2147483647, ttl_ms: int = WEEK_MS) -> DataFrame:
    """``name, ts, rate`` of a stream of cumulative ``name, ts, value`` (longs); -1 for a first row or no time between."""

    def step(key, rows, state):
        out = []
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            rate = -1.0
            if state and ts != state[0]:
                grown = value - state[1] if value >= state[1] else wrap - state[1] + value
                rate = grown / (ts - state[0])
            out.append((key[0], int(ts), float(rate)))
            state = (int(ts), int(value))
        return pd.DataFrame(out, columns=["name", "ts", "rate"]), state

    return _keyed(counters, ["name"], step, "name string, ts long, rate double", "ts long, value long", ttl_ms)


def admitted(runs: DataFrame, ifelapsed: int, ttl_ms: int = WEEK_MS) -> DataFrame:
    """``item, ts`` of runs that are at least ``ifelapsed`` whole minutes after the last that was let through."""

    def step(key, rows, state):
        last, out = (state[0] if state else None), []
        for ts in rows["ts"]:
            if last is None or (ts - last) // 60 >= ifelapsed:
                last = int(ts)
                out.append((key[0], last))
        return pd.DataFrame(out, columns=["item", "ts"]), (last,)

    return _keyed(runs, ["item"], step, "item string, ts long", "last long", ttl_ms)


def persistent(classes: DataFrame, ttl: int, policy: str = "reset", ttl_ms: int = WEEK_MS) -> DataFrame:
    """``name, until`` of a stream of ``name, ts``: how long a class is defined after each batch."""

    def step(key, rows, state):
        until = state[0] if state else None
        for ts in rows["ts"]:
            if policy == "reset" or until is None or ts >= until:
                until = int(ts) + ttl
        return pd.DataFrame({"name": [key[0]], "until": [until]}), (until,)

    return _keyed(classes, ["name"], step, "name string, until long", "until long", ttl_ms)


def on_change(stream: DataFrame, compare: Callable[[DataFrame, DataFrame], DataFrame], table: str, sink: Callable[[DataFrame, int], None], **options):
    """Starts a query that compares each batch (a whole state list) with the one before and hands the changes to ``sink``.

    The state list is kept as a table under ``table``, one folder for each batch, so a
    batch that is run again after a failure meets the same list before it.
    """

    def batch(now: DataFrame, number: int) -> None:
        spark = now.sparkSession
        now = now.distinct()
        now.write.mode("overwrite").parquet(f"{table}/{number}")
        kept = spark.read.parquet(f"{table}/{number}")
        before = spark.read.schema(now.schema).parquet(f"{table}/{number - 1}") if number else kept.limit(0)
        sink(compare(before, kept), number)

    writer = stream.writeStream.foreachBatch(batch)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer


def cycle(stream: DataFrame, seconds: int = 60):
    """A writer that looks for new rows once a cycle."""
    return stream.writeStream.trigger(processingTime=f"{seconds} seconds")


def watched_tuples(spark, path: str, clean: bool = True) -> DataFrame:
    """Tuples of files that appear in a folder; files that were read are deleted."""
    from ..sources.files import parse_tuples

    reader = spark.readStream.option("maxFilesPerTrigger", 1000)
    reader = reader.option("cleanSource", "delete") if clean else reader
    return parse_tuples(reader.text(path))
