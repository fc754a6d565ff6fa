"""Logic-less templates over JSON: ``{{x}}`` escaped, ``{{{x}}}`` and ``{{&x}}`` as it is, ``{{%x}}`` and ``{{$x}}`` as JSON (spread out, compact), sections ``#``, inverted ``^``, comments ``!``, new delimiters ``=``."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _parse(template: str) -> list:
    """A tree of ``str``, ``(kind, name)`` and ``(kind, name, children)``."""
    left, right, at = "{{", "}}", 0
    stack: list[tuple[str, str, list]] = [("", "", [])]
    while True:
        start = template.find(left, at)
        if start < 0:
            stack[-1][2].append(template[at:])
            break
        stack[-1][2].append(template[at:start])
        triple = left == "{{" and template.startswith("{{{", start)
        close = "}}}" if triple else right
        end = template.find(close, start + len(left))
        if end < 0:
            raise ValueError("a tag is not closed")
        body = template[start + len(left) + triple : end].strip()
        at = end + len(close)
        kind, name = ("&", body) if triple else (body[:1], body[1:].strip()) if body[:1] in tuple("#^/!=&%$") else ("", body)
        if kind in ("#", "^"):
            stack.append((kind, name, []))
        elif kind == "/":
            if len(stack) < 2 or stack[-1][1] != name:
                raise ValueError(f"section {name} is not open")
            done = stack.pop()
            stack[-1][2].append(done)
        elif kind == "=":
            left, right = re.split(r"\s+", name.rstrip("=").strip())
        elif kind != "!":
            stack[-1][2].append((kind, name))
    if len(stack) > 1:
        raise ValueError(f"section {stack[-1][1]} is not closed")
    return stack[0][2]


def _find(name: str, scopes: list):
    if name in (".", "@"):
        return scopes[-1]
    for scope in reversed(scopes):
        value = scope
        for part in name.split("."):
            value = value.get(part) if isinstance(value, dict) else None
            if value is None:
                break
        if value is not None:
            return value
    return None


def _plain(value) -> str:
    if value is None or isinstance(value, (dict, list)):
        return ""
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def _render(tree: list, scopes: list) -> str:
    out = []
    for node in tree:
        if isinstance(node, str):
            out.append(node)
            continue
        kind, name, *rest = node
        value = _find(name, scopes)
        if kind == "#":
            if isinstance(value, list):
                out += [_render(rest[0], [*scopes, x]) for x in value]
            elif value or value == 0 and value is not False:
                out.append(_render(rest[0], [*scopes, value]))
        elif kind == "^":
            if value in (None, False, "") or value == [] or value == {}:
                out.append(_render(rest[0], scopes))
        elif kind == "%":
            out.append(json.dumps(value, indent=2))
        elif kind == "$":
            out.append(json.dumps(value, separators=(",", ":")))
        else:
            out.append(_plain(value) if kind == "&" else html.escape(_plain(value)))
    return "".join(out)


def render(template: str, data) -> str:
    return _render(_parse(template), [data])


def rendered(template: str, data: Column) -> Column:
    """The template over a JSON column, in Arrow batches; null for JSON that can't be parsed."""
    _parse(template)  # errors show where the plan is built

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        tree = _parse(template)

        def one(x):
            try:
                return _render(tree, [json.loads(x)])
            except (TypeError, ValueError):
                return None

        return rows.map(one)

    return run(data)
