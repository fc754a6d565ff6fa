"""Choice by chance. Each function takes a draw or a key, so a stable key gives a stable choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column) -> Column:
    """A number from 0 up to 1 that depends on the key alone: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0


def random_int(low: int, high: int, chance: Column | None = None) -> Column:
    """An integer from the lower bound on, the upper excluded; bounds may come in either order."""
    low, high = min(low, high), max(low, high)
    return F.floor(low + (F.rand() if chance is None else chance) * (high - low)).cast("long")


def weighted(weights: dict[str, int], chance: Column) -> Column:
    """A name by its share of all weights; a negative weight or none at all is an error."""
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative and not all zero")
    out, reached = F.lit(None).cast("string"), total
    for name, weight in reversed(weights.items()):
        out = F.when(chance * total < reached, name).otherwise(out)
        reached -= weight
    return out


def shuffled(values: Column, seed: Column) -> Column:
    """The list in an order that depends on the seed alone."""
    keyed = F.transform(values, lambda x, i: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"), x)).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def splay_class(key: Column, policy: str = "hourly") -> Column:
    """The five-minute class of an hour, or of a day, in which a key has its turn."""
    slots = 12 if policy == "hourly" else 288
    slot = F.floor(draw(key) * slots).cast("int")
    low = (slot % 12) * 5
    minutes = F.format_string("Min%02d_%02d", low, (low + 5) % 60)
    return minutes if policy == "hourly" else F.concat(minutes, F.format_string(".Hr%02d", F.floor(slot / 12).cast("int")))


def splay_arrived(key: Column, ts: Column, policy: str = "hourly") -> Column:
    """Whether a time lies in the key's slot."""
    low = (F.floor(F.minute(ts) / 5) * 5).cast("int")
    now = F.format_string("Min%02d_%02d", low, (low + 5) % 60)
    now = now if policy == "hourly" else F.concat(now, F.format_string(".Hr%02d", F.hour(ts)))
    return splay_class(key, policy) == now
