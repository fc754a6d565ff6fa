"""YAML as JSON text: block and flow maps and lists, scalars, comments and block strings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INT, _REAL = re.compile(r"[-+]?\d+\Z"), re.compile(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?\Z")
# Words that stand for constants.
WORDS = {"true": True, "false": False, "yes": True, "no": False, "null": None, "~": None, "": None}


class _Flow:
    """One flow value: ``[a, {b: c}]``, a quoted or a plain scalar."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self):
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def value(self, ends: str = ""):
        self.blank()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            return self.many("]", lambda: self.value(",]"))
        if c == "{":
            return dict(self.many("}", self.pair))
        if c in ("'", '"'):
            return self.quoted(c)
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in ends:
            self.at += 1
        return scalar(self.text[begin : self.at].strip())

    def many(self, close: str, one):
        self.at += 1
        out = []
        while True:
            self.blank()
            if self.at >= len(self.text):
                raise ValueError("a flow value is not closed")
            if self.text[self.at] == close:
                self.at += 1
                return out
            if self.text[self.at] == ",":
                self.at += 1
                continue
            out.append(one())

    def pair(self):
        key = self.value(":")
        self.blank()
        if self.text[self.at : self.at + 1] != ":":
            raise ValueError("a key without a colon")
        self.at += 1
        return str(key), self.value(",}")

    def quoted(self, mark: str):
        end, self.at = self.at + 1, self.at + 1
        out = ""
        while end < len(self.text):
            c = self.text[end]
            if c == "\\" and mark == '"':
                out += json.loads(f'"{self.text[end : end + 2]}"') if self.text[end + 1] in '"\\/bfnrt' else self.text[end + 1]
                end += 2
            elif c == mark and mark == "'" and self.text[end + 1 : end + 2] == "'":
                out, end = out + "'", end + 2
            elif c == mark:
                self.at = end + 1
                return out
            else:
                out, end = out + c, end + 1
        raise ValueError("a string is not closed")


def scalar(text: str):
    if text.lower() in WORDS:
        return WORDS[text.lower()]
    return int(text) if _INT.match(text) else float(text) if _REAL.match(text) else text


def _without_comment(line: str) -> str:
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (k == 0 or line[k - 1].isspace()):
            return line[:k]
    return line


_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^\s'"\[{#][^:#]*?)\s*:(?:\s+(.*)|)\Z""")


def load(text: str):
    """The value of a document; what can't be read raises ``ValueError``."""
    raw = [x for x in text.split("\n") if not x.startswith(("---", "%"))]
    lines = [(len(x) - len(x.lstrip()), _without_comment(x).strip(), k) for k, x in enumerate(raw)]
    lines = [x for x in lines if x[1] and x[1] != "..."]
    at = 0

    def inline(rest: str, indent: int):
        nonlocal at
        if rest and rest[0] in "|>" and len(rest) <= 2:
            return block(rest, indent)
        if rest == "":
            if at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
                return node(lines[at][0])
            return None
        flow = _Flow(rest)
        value = flow.value()
        if rest[0] in "[{'\"" and rest[flow.at :].strip():
            raise ValueError(f"text after a value: {rest}")
        return value

    def block(mark: str, indent: int):
        nonlocal at
        first, out = lines[at - 1][2] + 1, []
        for k in range(first, len(raw)):
            if raw[k].strip() and len(raw[k]) - len(raw[k].lstrip()) <= indent:
                break
            out.append(raw[k])
        while at < len(lines) and lines[at][2] < first + len(out):
            at += 1
        while out and not out[-1].strip():
            out.pop()
        depth = min((len(x) - len(x.lstrip()) for x in out if x.strip()), default=0)
        out = [x[depth:] for x in out]
        return ("\n" if mark[0] == "|" else " ").join(out) + ("" if mark.endswith("-") else "\n")

    def node(indent: int):
        nonlocal at
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
                rest = lines[at][1][1:].strip()
                if rest.startswith("- ") or (_KEY.match(rest) and rest[0] not in "[{"):
                    inner = indent + len(lines[at][1]) - len(lines[at][1][1:].lstrip())
                    lines[at] = (inner, rest, lines[at][2])
                    out.append(node(inner))
                else:
                    at += 1
                    out.append(inline(rest, indent))
            return out
        if m := _KEY.match(lines[at][1]):
            out = {}
            while at < len(lines) and lines[at][0] == indent and (m := _KEY.match(lines[at][1])):
                key = m[1][1:-1] if m[1][0] in "'\"" else m[1]
                at += 1
                out[key] = inline((m[2] or "").strip(), indent)
            if at < len(lines) and lines[at][0] > indent:
                raise ValueError(f"indentation: {lines[at][1]}")
            return out
        at += 1
        return inline(lines[at - 1][1], indent)

    if not lines:
        return None
    out = node(lines[0][0])
    if at < len(lines):
        raise ValueError(f"not read: {lines[at][1]}")
    return out


def parsed(text: Column) -> Column:
    """A YAML document as JSON text; null for null or what can't be read. Arrow batches, as the engine has no parser of its own."""

    def one(x):
        try:
            return None if x is None else json.dumps(load(x), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, IndexError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return run(text)


def read_yaml(spark, path: str):
    """``path, json`` of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parsed(F.col("value")).alias("json"))
