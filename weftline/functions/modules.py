"""Lines of the module protocol and of small captured files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first letter of a line and what the line says.
KINDS = {"+": "class", "-": "cancel", "=": "variable", "@": "list", "%": "data", "^": "context"}


def parse_line(line: Column) -> Column:
    """``kind, name, value`` of a protocol line, null for any other.

    ``+name`` and ``-name`` set and cancel classes, ``=name=text`` a variable,
    ``@name={...}`` a list, ``%name=json`` a container, ``^key=text`` the context of what follows.
    """
    first, rest = F.left(line, F.lit(1)), F.substring(line, 2, 1 << 30)
    kind = F.lit(None).cast("string")
    for k, v in KINDS.items():
        kind = F.when(first == k, v).otherwise(kind)
    plain = first.isin("+", "-")
    cut = F.split(rest, "=", 2)
    good = kind.isNotNull() & (plain | rest.contains("="))
    return F.when(good, F.struct(kind.alias("kind"), F.when(plain, F.trim(rest)).otherwise(cut[0]).alias("name"), F.when(~plain, F.get(cut, 1)).alias("value")))


def list_items(value: Column) -> Column:
    """Elements of ``{ "a", "b" }``."""
    return F.regexp_extract_all(value, F.lit("['\"]([^'\"]*)['\"]"), F.lit(1))


def load_average(text: Column) -> Column:
    """The one-minute load of ``/proc/loadavg``."""
    return F.get(F.split(text, " +"), 0).try_cast("double")


def memory(text: Column, name: str) -> Column:
    """Kilobytes of one line of ``/proc/meminfo``."""
    return F.regexp_extract(text, rf"(?m)^{name}:\s*(\d+)", 1).try_cast("long")


def cpu_busy(text: Column) -> Column:
    """Busy share of the first line of ``/proc/stat``, over all its counters: all but idle."""
    parts = F.transform(F.split(F.regexp_extract(text, r"(?m)^cpu +(.*)$", 1), " +"), lambda x: x.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    return 1 - F.get(parts, 3) / total


def disk_traffic(text: Column, device: str) -> Column:
    """``reads, writes`` of a device in ``/proc/diskstats``."""
    line = rf"(?m)^ *\d+ +\d+ +{device} +(\d+) +\d+ +\d+ +\d+ +(\d+)"
    return F.struct(F.regexp_extract(text, line, 1).try_cast("long").alias("reads"), F.regexp_extract(text, line, 2).try_cast("long").alias("writes"))
