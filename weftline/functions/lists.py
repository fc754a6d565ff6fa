"""List, map and JSON functions. Lists are arrays of strings in a significant order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import full_match


def number(x: Column) -> Column:
    return x.try_cast("double")


def every(values: Column, pattern: str) -> Column:
    """False for an empty list."""
    return F.forall(values, lambda x: full_match(x, pattern)) & (F.size(values) > 0)


def some(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda x: full_match(x, pattern))


def none(values: Column, pattern: str) -> Column:
    return ~some(values, pattern)


def grep(values: Column, pattern: str) -> Column:
    return F.filter(values, lambda x: full_match(x, pattern))


def filtered(values: Column, pattern: str, is_regex: bool = True, invert: bool = False, most: int | None = None) -> Column:
    hit = (lambda x: full_match(x, pattern)) if is_regex else (lambda x: x == pattern)
    out = F.filter(values, (lambda x: ~hit(x)) if invert else hit)
    return out if most is None else F.slice(out, 1, most)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def unique(values: Column) -> Column:
    return F.array_distinct(values)


def sublist(values: Column, side: str, n: int) -> Column:
    return F.slice(values, 1, n) if side == "head" else F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, F.lit(n))


def nth(values: Column, i: int) -> Column:
    return F.get(values, i)


def total(values: Column) -> Column:
    """Null if one element is no number; 0 for an empty list."""
    return F.when(~F.exists(values, lambda x: number(x).isNull()), F.aggregate(values, F.lit(0.0), lambda a, x: a + number(x)))


def product(values: Column) -> Column:
    return F.when(~F.exists(values, lambda x: number(x).isNull()), F.aggregate(values, F.lit(1.0), lambda a, x: a * number(x)))


def mean(values: Column) -> Column:
    """Elements that are no numbers count as 0; null for an empty list."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(number(x), F.lit(0.0))) / F.size(values))


def variance(values: Column) -> Column:
    """Of a sample; 0 for one element, null for none."""
    n, m = F.size(values), mean(values)
    squares = F.aggregate(F.transform(values, lambda x: F.coalesce(number(x), F.lit(0.0)) - m), F.lit(0.0), lambda a, d: a + d * d)
    return F.when(n == 1, 0.0).when(n > 1, squares / (n - 1))


def _sort_key(mode: str):
    if mode == "lex":
        return lambda x: F.struct(x)
    if mode in ("int", "real"):
        cut = (lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")) if mode == "int" else (lambda v: v)
        return lambda x: F.struct(number(x).isNotNull(), F.coalesce(cut(number(x)), F.lit(0.0)), F.when(number(x).isNull(), x).otherwise(""))
    if mode == "IP":
        return lambda x: F.struct(F.transform(F.split(x, r"\."), lambda p: p.try_cast("int")))
    if mode == "MAC":
        return lambda x: F.struct(F.transform(F.split(x, ":"), lambda p: F.conv(p, 16, 10).cast("int")))
    raise ValueError(mode)


def sort(values: Column, mode: str = "lex") -> Column:
    """Stable; by bytes, number (after what is no number), IPv4 or MAC address."""
    key = _sort_key(mode)
    keyed = F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def greatest(values: Column, mode: str = "lex") -> Column:
    """The first of the largest."""
    key = _sort_key(mode)
    keyed = F.transform(values, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x")))
    return F.array_max(keyed)["x"]


def least(values: Column, mode: str = "lex") -> Column:
    """The last of the smallest."""
    key = _sort_key(mode)
    keyed = F.transform(values, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x")))
    return F.array_min(keyed)["x"]


def expandrange(prefix: str, low: Column, high: Column, step: int, suffix: str = "") -> Column:
    """Inclusive; runs down where ``low`` is above ``high``."""
    signed = F.when(low <= high, step).otherwise(-step)
    return F.transform(F.sequence(low, high, signed), lambda i: F.concat(F.lit(prefix), i.cast("string"), F.lit(suffix)))


def joined(values: Column, glue: str) -> Column:
    return F.array_join(values, glue)


def merge_maps(a: Column, b: Column) -> Column:
    """The second map wins."""
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def ring(values: Column, n: int) -> Column:
    """What a ring buffer of ``n`` holds after all were appended."""
    return F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, F.lit(n))


def token_overlap(intended: Column, actual: Column) -> Column:
    """Common-prefix score of tokens, 0 to 100: of each pair with a common prefix over three letters, its length over the length of the longer part."""
    tokens = lambda c: F.filter(F.split(c, "[ ,]+"), lambda t: t != "")

    def pair(x, y):
        least = F.least(F.char_length(x), F.char_length(y))
        same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda k: (k <= least) & (F.left(x, k) == F.left(y, k))))
        long = same > 3
        return F.struct(F.when(long, same).otherwise(0).alias("s"), F.when(long, F.greatest(F.char_length(x), F.char_length(y))).otherwise(F.char_length(x)).alias("t"))

    pairs = F.flatten(F.transform(tokens(intended), lambda x: F.transform(tokens(actual), lambda y: pair(x, y))))
    score, size = F.aggregate(pairs, F.lit(0), lambda a, p: a + p["s"]), F.aggregate(pairs, F.lit(0), lambda a, p: a + p["t"])
    return F.when(size > 0, F.floor(100 * score / size)).otherwise(0).cast("long")


def rrange(low: Column, high: Column) -> Column:
    """A range of reals, its bounds in order."""
    low, high = low.cast("double"), high.cast("double")
    return F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))


def in_range(value: Column, of: Column) -> Column:
    return value.between(of["low"], of["high"])


def sorted_by(values: Column, field: str) -> Column:
    """Containers (structs) in the order of a field, ties by the rest."""
    keyed = F.transform(values, lambda x: F.struct(x[field].alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def set_add(values: Column, item: Column) -> Column:
    """A set as a list in the order of first appearance, with one more item."""
    return F.array_distinct(F.concat(values, F.array(item)))


def set_remove(values: Column, item: Column) -> Column:
    return F.filter(values, lambda x: x != item)


def set_equal(a: Column, b: Column) -> Column:
    return subset(a, b) & subset(b, a)


def map_remove(values: Column, key: Column) -> Column:
    return F.map_filter(values, lambda k, v: k != key)
