"""Boolean guards over class labels, compiled to Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*([A-Za-z0-9_:]+|\|\||[!.&|()])")


def compile_guard(text: str, leaf) -> Column:
    """``!`` binds first, then ``.`` or ``&``, then ``|`` or ``||``; ``leaf`` gives the Column of a name."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"guard: {text!r} at {at}")
        tokens.append(m[1])
        at = m.end()
    tokens.append("")
    place = 0

    def take(*ops):
        nonlocal place
        if tokens[place] in ops:
            place += 1
            return True
        return False

    def either():
        left = both()
        while take("|", "||"):
            left = left | both()
        return left

    def both():
        left = one()
        while take(".", "&"):
            left = left & one()
        return left

    def one():
        nonlocal place
        if take("!"):
            return ~one()
        if take("("):
            inner = either()
            if not take(")"):
                raise ValueError(f"guard: {text!r} lacks a parenthesis")
            return inner
        name = tokens[place]
        if not name or not re.match(r"[A-Za-z0-9_]", name):
            raise ValueError(f"guard: {text!r}")
        place += 1
        return leaf(name)

    out = either()
    if tokens[place]:
        raise ValueError(f"guard: {text!r} goes on after its end")
    return out


def in_classes(classes: Column):
    return lambda name: F.array_contains(classes, name)


def exactly_odd(*conditions: Column) -> Column:
    """Exclusive or."""
    return sum((c.cast("int") for c in conditions[1:]), conditions[0].cast("int")) % 2 == 1


def bucket_of(value: Column, n: int) -> Column:
    """A stable bucket of a key, from its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long"), F.lit(n))
