"""Nested text as leaves with coordinates: XML tags and ``{} [] ()`` in any mixture.

A leaf is the text between two neighbouring brackets. Its coordinates count, for each
depth, which child it is in; its delimiters name the brackets around it; its values
are quoted strings or runs without blanks, commas and semicolons. One document is
read by one task, in order; documents are independent.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

_BRACKET = re.compile(r"<(/?)([A-Za-z][\w:.-]*)([^<>]*?)(/?)>|([{\[(])|([}\])])")
_ITEM = re.compile(r'"[^"]*"|[^\s,;]+')
_CLOSES = {"}": "{", "]": "[", ")": "("}


def leaves(text: str):
    """``(coordinates, delimiters, values)`` of each leaf, and whether all brackets were closed.

    A closing bracket ends the nearest open one of its kind with all inside it; one
    without a partner is text. A tag without an end tag stays open.
    """
    out, open_, counters, at = [], [], [0], 0

    def leaf(part):
        values = _ITEM.findall(part)
        if values:
            counters[-1] += 1
            out.append((list(counters), list(open_), values))

    for m in _BRACKET.finditer(text):
        slash, tag, _, alone, opens, closes = m.groups()
        partner = tag if slash else _CLOSES.get(closes or "")
        if partner and partner not in open_:
            continue
        leaf(text[at : m.start()])
        at = m.end()
        if partner:
            while open_:
                counters.pop()
                if open_.pop() == partner:
                    break
        elif not alone:
            counters[-1] += 1
            counters.append(0)
            open_.append(tag or opens)
    leaf(text[at:])
    return out, not open_


SCHEMA = "doc string, seg long, coords array<int>, delims array<string>, vals array<string>, closed boolean"


def segments(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per leaf of each document; null texts have none."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, closed = leaves(t or "")
                rows += [(d, k, *x, closed) for k, x in enumerate(found)]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
                names = ["doc", "seg", "coords", "delims", "vals", "closed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(docs[doc].cast("string"), docs[text]).mapInArrow(run, SCHEMA)
