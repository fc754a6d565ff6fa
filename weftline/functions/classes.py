"""Catalogues of defined classes and variables: matching by whole name and by tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import canonify, full_match


def classify(name: Column, classes: Column) -> Column:
    """Whether the canonical form of a name is a defined class."""
    return F.array_contains(classes, canonify(name))


def matches_any(classes: Column, pattern: str) -> Column:
    return F.exists(classes, lambda x: full_match(x, pattern))


def matching(classes: Column, pattern: str) -> Column:
    """The classes that match, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(classes, lambda x: full_match(x, pattern))))


def named(catalogue: DataFrame, pattern: str, *tags: str, name: str = "name", of: str = "tags") -> DataFrame:
    """Rows of a catalogue whose name matches and that have, for each further pattern, a tag that matches it."""
    test = full_match(F.col(name), pattern)
    for tag in tags:
        test = test & F.coalesce(F.exists(of, lambda x: full_match(x, tag)), F.lit(False))
    return catalogue.where(test)


def tags_of(catalogue: DataFrame, wanted: str, name: str = "name", of: str = "tags") -> DataFrame:
    """``tag`` rows of one name; none if it is not defined."""
    return catalogue.where(F.col(name) == wanted).select(F.explode(of).alias("tag"))


def is_defined(names: Column, name: Column) -> Column:
    return F.array_contains(names, name)


def state(variables: DataFrame, scope: str, name: str, value: str) -> DataFrame:
    """One JSON object of names and values for each scope, names in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).cast("string"), F.col(value).cast("string"))))
    return variables.groupBy(scope).agg(F.to_json(F.map_from_entries(pairs)).alias("state"))
