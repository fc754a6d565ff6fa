"""String functions. A failure is null; lists are arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(value: Column, pattern: str) -> Column:
    """Whether all of ``value`` matches; dots match line ends and anchors match at lines."""
    return value.rlike(rf"(?ms)\A(?:{pattern})\z")


def canonify(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9_]", "_")


def canonify_uniquely(value: Column) -> Column:
    return F.concat(canonify(value), F.lit("_"), F.sha1(value))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def lastnode(path: Column, separator: str) -> Column:
    return F.element_at(F.split(path, separator), -1)


def escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def string_head(value: Column, n: int) -> Column:
    return F.left(value, F.lit(n))


def string_tail(value: Column, n: int) -> Column:
    return F.right(value, F.lit(n))


def string_length(value: Column) -> Column:
    """Bytes, not characters."""
    return F.octet_length(value).cast("long")


def splitstring(value: Column, separator: str, most: int) -> Column:
    """At most ``most`` parts; what is beyond is dropped."""
    return F.slice(F.split(value, separator), 1, most)


def string_split(value: Column, separator: str, most: int) -> Column:
    """At most ``most`` parts; the last keeps the rest."""
    return F.split(value, separator, most)


def digest(value: Column, kind: str) -> Column:
    known = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda v: F.sha2(v, 256), "sha384": lambda v: F.sha2(v, 384), "sha512": lambda v: F.sha2(v, 512)}
    return known[kind](value)


def _number(value: Column) -> Column:
    return value.try_cast("double")


def is_greater_than(a: Column, b: Column) -> Column:
    """By number if both are numbers, else by bytes."""
    x, y = _number(a), _number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x > y).otherwise(a > b)


def is_less_than(a: Column, b: Column) -> Column:
    x, y = _number(a), _number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x < y).otherwise(a < b)


def regextract(value: Column, pattern: str, groups: int) -> Column:
    """Map of group number to text where all of ``value`` matches, else null."""
    whole = rf"(?ms)\A(?:{pattern})\z"
    pairs = [x for i in range(groups + 1) for x in (F.lit(i), F.regexp_extract(value, whole, i))]
    return F.when(full_match(value, pattern), F.create_map(*pairs))


def template(text: str, values: dict[str, Column]) -> Column:
    """Text with every ``$(name)`` replaced by its column; unknown names stay as they are."""
    parts, rest = [], text
    while "$(" in rest:
        before, _, rest = rest.partition("$(")
        name, closed, rest = rest.partition(")")
        parts.append(F.lit(before))
        parts.append(values[name].cast("string") if closed and name in values else F.lit(f"$({name}{closed}"))
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(rest)


def ip_number(address: Column) -> Column:
    """An IPv4 address as an integer, null if it isn't one."""
    part = F.split(address, r"\.")
    return F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long")))


def in_ip_range(address: Column, cidr: str) -> Column:
    net, _, bits = cidr.partition("/")
    low = 0
    for x in net.split("."):
        low = low * 256 + int(x)
    size = 1 << (32 - int(bits or 32))
    low -= low % size
    return ip_number(address).between(low, low + size - 1)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the numbers between dots; a shorter version comes first."""
    numbers = lambda v: F.transform(F.split(v, r"\."), lambda x: x.try_cast("long"))
    x, y = numbers(a), numbers(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def translate_path(path: Column, separator: str = "/") -> Column:
    """A path with the separators of a system."""
    return path if separator == "/" else F.replace(path, F.lit("/"), F.lit(separator))


def count_tokens(value: Column, separators: str) -> Column:
    return F.size(F.filter(F.split(value, separators), lambda x: x != "")).cast("long")


def token(value: Column, separators: str, i: int) -> Column:
    return F.get(F.filter(F.split(value, separators), lambda x: x != ""), i)
