"""Stateful streams: the periodic model, last-seen registry and bucket counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import time_key

STATE = "expect double, var double, n long"
WEEK_MS = 7 * 86_400_000


def _learn(p: float, ttl_ms: int):
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        expect, var, n = state.get if state.exists else (0.0, 0.0, 0)
        for frame in frames:
            for q in frame.sort_values("ts")["value"]:
                if n:
                    var = p * (q - expect) ** 2 + (1 - p) * var
                    expect = p * q + (1 - p) * expect
                else:
                    expect, var = float(q), 0.0
                n += 1
        state.update((expect, var, n))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"timekey": [key[0]], "observable": [key[1]], "expect": [expect], "var": [var], "n": [n]})

    return step


def learn(samples: DataFrame, p: float = 0.7, ttl_ms: int = 2 * WEEK_MS) -> DataFrame:
    """The weekly model of a stream of ``ts, observable, value``: state per slot and observable, dropped after ``ttl_ms`` without samples."""
    keyed = samples.select(time_key(F.col("ts")).alias("timekey"), "observable", "ts", F.col("value").cast("double").alias("value"))
    return keyed.groupBy("timekey", "observable").applyInPandasWithState(_learn(p, ttl_ms), "timekey string, observable string, expect double, var double, n long", STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def bucket_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts by five-minute window and name, emitted once a window is past its watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes"), "name").agg(F.count("*").alias("n"))


def tail_lines(spark, path: str) -> DataFrame:
    """Lines of files as they appear; the checkpoint remembers what was read."""
    return spark.readStream.text(path)
