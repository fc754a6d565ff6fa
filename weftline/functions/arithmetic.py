"""Arithmetic text, parsed on the driver into one Column expression.

``+ - * / % ^ **``, ``==``, parentheses, functions, constants and the suffixes k, m, g, t, p.
Text that can't be parsed gives an empty string, as does nothing else; a result has six decimals.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes, the constants and the functions of the expression language.
SUFFIXES = {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "p": 1e15}
CONSTANTS = {"e": math.e, "pi": math.pi, "log2e": math.log2(math.e), "log10e": math.log10(math.e), "ln2": math.log(2), "ln10": math.log(10), "pi_2": math.pi / 2, "pi_4": math.pi / 4, "1_pi": 1 / math.pi, "2_pi": 2 / math.pi, "2_sqrtpi": 2 / math.sqrt(math.pi), "sqrt2": math.sqrt(2), "sqrt1_2": math.sqrt(0.5)}
FUNCTIONS = {"ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "log10": F.log10, "log2": F.log2, "log": F.log, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "abs": F.abs, "step": lambda x: F.when(x < 0, 0.0).otherwise(1.0)}

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)([kmgtp])?(?![A-Za-z_])|\$\((\w+)\)|([A-Za-z0-9_]+)|(\*\*|==|[-+*/%^()]))")


class _Parser:
    def __init__(self, text: str, columns: dict[str, Column]):
        self.columns, self.tokens, at = columns, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def op(self) -> str | None:
        return self.tokens[self.at][5] if self.at < len(self.tokens) else None

    def take(self, *ops: str) -> str | None:
        if (o := self.op()) in ops and o:
            self.at += 1
            return o
        return None

    def equal(self) -> Column:
        left = self.sum()
        while self.take("=="):
            left = F.when(F.abs(left - self.sum()) < 1e-12, 1.0).otherwise(0.0)
        return left

    def sum(self) -> Column:
        left = self.term()
        while o := self.take("+", "-"):
            right = self.term()
            left = left + right if o == "+" else left - right
        return left

    def term(self) -> Column:
        left = self.power()
        while o := self.take("*", "/", "%"):
            right = self.power()
            if o == "*":
                left = left * right
            elif o == "/":
                signed = F.when(left > 0, float("inf")).when(left < 0, float("-inf")).otherwise(float("nan"))
                left = F.when(right != 0, F.try_divide(left, right)).otherwise(signed)
            else:
                left = F.try_mod(left, right)
        return left

    def power(self) -> Column:
        left = self.unit()
        return F.pow(left, self.power()) if self.take("^", "**") else left

    def unit(self) -> Column:
        if self.take("-"):
            return -self.unit_number()
        return self.unit_number()

    def unit_number(self) -> Column:
        if self.take("("):
            inner = self.equal()
            if not self.take(")"):
                raise ValueError("parenthesis")
            return inner
        if self.at >= len(self.tokens):
            raise ValueError("end")
        m = self.tokens[self.at]
        self.at += 1
        if m[1]:
            return F.lit(float(m[1]) * SUFFIXES.get(m[2], 1.0))
        if m[3]:
            return self.columns[m[3]].cast("double")
        if m[4] in FUNCTIONS and self.take("("):
            inner = self.equal()
            if not self.take(")"):
                raise ValueError("parenthesis")
            return FUNCTIONS[m[4]](inner)
        if m[4] in CONSTANTS:
            return F.lit(CONSTANTS[m[4]])
        raise ValueError(m[0])


def evaluate(text: str, columns: dict[str, Column] | None = None) -> Column:
    """The value as a double; null where the text can't be parsed. ``$(name)`` is a column; nothing is 0."""
    if not text.strip():
        return F.lit(0.0)
    try:
        p = _Parser(text, columns or {})
        out = p.equal()
        if p.at < len(p.tokens):
            raise ValueError(text)
        return out
    except ValueError:
        return F.lit(None).cast("double")


def evaluated_text(text: str, columns: dict[str, Column] | None = None) -> Column:
    value = evaluate(text, columns)
    return F.when(value.isNull(), "").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%.6f", value))
