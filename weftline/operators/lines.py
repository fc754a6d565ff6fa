"""Edits of texts as arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import full_match


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def delete_lines(values: Column, pattern: str, mode: str = "match", invert: bool = False) -> Column:
    """``startwith`` and ``contains`` take literal text, ``match`` a regular expression for the whole line."""
    hit = {"match": lambda x: full_match(x, pattern), "startwith": lambda x: x.startswith(pattern), "contains": lambda x: x.contains(pattern)}[mode]
    return F.filter(values, lambda x: hit(x) if invert else ~hit(x))


def insert_line(values: Column, line: str, after: str | None = None) -> Column:
    """Adds a line once: after the first full match of ``after``, else at the end; an equal line is left alone."""
    there = F.array_contains(values, line)
    if after is None:
        return F.when(there, values).otherwise(F.array_append(values, line))
    at = F.array_position(F.transform(values, lambda x: full_match(x, after)), True)
    return F.when(there | (at == 0), values).otherwise(F.concat(F.slice(values, F.lit(1), at.cast("int")), F.array(F.lit(line)), F.slice(values, (at + 1).cast("int"), F.size(values))))


def replace_all(values: Column, pattern: str, by: str) -> Column:
    return F.transform(values, lambda x: F.regexp_replace(x, pattern, by))


def still_matches(values: Column, pattern: str) -> Column:
    """Whether a rewritten text would be rewritten again."""
    return F.exists(values, lambda x: x.rlike(pattern))


def edit_field(line: Column, separator: str, index: int, value: str | None) -> Column:
    """Sets the n-th field (from 1), or blanks it for null; a line without that field stays."""
    parts = F.split(line, separator)
    new = F.transform(parts, lambda x, i: F.when(i == index - 1, F.lit(value or "")).otherwise(x))
    return F.when(F.size(parts) >= index, F.array_join(new, separator)).otherwise(line)


def region(values: Column, start: str, end: str, include: bool = False) -> Column:
    """Lines after the first full match of ``start`` up to the next of ``end``, or to the last; none without a start."""
    at = F.array_position(F.transform(values, lambda x: full_match(x, start)), True).cast("int")
    tail = F.slice(values, at + 1, F.size(values))
    stop = F.array_position(F.transform(tail, lambda x: full_match(x, end)), True).cast("int")
    inner = F.when(stop > 0, F.slice(tail, F.lit(1), stop - 1)).otherwise(tail)
    return F.when(at == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice(values, at, F.lit(1)), inner) if include else inner)
