"""Arrays and lists out of the lines of a text: by first field or by line number, as strings, integers or reals."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import full_match

KINDS = {"string": "string", "int": "long", "real": "double"}


def rows_of(text: Column, comment: str, separator: str, most_lines: int | None = None) -> Column:
    """Fields of each line that is not empty once comments are gone, in order."""
    lines = F.filter(F.split(F.regexp_replace(text, comment, ""), "\n"), lambda x: F.trim(x) != "")
    lines = lines if most_lines is None else F.slice(lines, 1, most_lines)
    return F.transform(lines, lambda x: F.split(x, separator))


def typed(values: Column, kind: str) -> Column:
    """Elements as a kind; one that is no number is null."""
    return F.transform(values, lambda x: F.trim(x).try_cast(KINDS[kind]) if kind != "string" else x)


def by_first_field(text: Column, comment: str, separator: str, kind: str = "string") -> Column:
    """Map of a line's first field to its other fields as a kind; later lines win."""
    rows = rows_of(text, comment, separator)
    entries = F.transform(rows, lambda f: F.struct(f[0].alias("key"), typed(F.slice(f, 2, F.size(f)), kind).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])))


def by_line(text: Column, comment: str, separator: str, kind: str = "string") -> Column:
    """Map of line numbers from 0 to all fields of a line as a kind."""
    rows = rows_of(text, comment, separator)
    return F.map_from_entries(F.transform(rows, lambda f, i: F.struct(i.cast("long").alias("key"), typed(f, kind).alias("value"))))


def nested(text: Column, comment: str, separator: str) -> Column:
    """All lines as an array of arrays."""
    return rows_of(text, comment, separator)


def typed_list(text: Column, comment: str, separator: str, kind: str, most: int) -> Column:
    parts = F.filter(F.split(F.regexp_replace(text, comment, ""), separator), lambda x: F.trim(x) != "")
    return typed(F.slice(parts, 1, most), kind)


def fields(text: Column, pattern: str, separator: str) -> Column:
    """``n, fields``: how many lines match as a whole, and the parts of the first that does."""
    hits = F.filter(F.split(text, "\n"), lambda x: full_match(x, pattern))
    return F.struct(F.size(hits).cast("long").alias("n"), F.split(F.get(hits, 0), separator).alias("fields"))


def count_lines(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: full_match(x, pattern))).cast("long")


def first_bytes(text: Column, most: int) -> Column:
    """The text as far as ``most`` bytes of UTF-8 go; a character that they cut is left out."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(cut, "\uFFFD+$", ""))


def read_file(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """``path, text`` of each file, as far as ``most`` bytes go."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files if most is None else files.withColumn("text", first_bytes(F.col("text"), most))


def file_facts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, name, size, modified`` of files; only metadata is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


_FACTS = "path string, name string, size long, modified timestamp"


def _listed(spark: SparkSession, path: str, of) -> DataFrame:
    """Facts of the files and folders that ``of(filesystem, path)`` names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [(x.getPath().toString(), x.getPath().getName(), x.getLen(), datetime.fromtimestamp(x.getModificationTime() / 1000, UTC)) for x in of(system, place) or ()]
    return spark.createDataFrame(found, _FACTS)


def find_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, name, size, modified`` of files and folders whose path matches a shell pattern.

    ``**`` stands for one to six levels; a wildcard does not match a leading dot.
    """

    def seen(status, parts):
        names = status.getPath().toString().split("/")[-len(parts) :]
        return all(p.startswith(".") or not n.startswith(".") for p, n in zip(parts, names, strict=False) if any(x in p for x in "*?["))

    out = None
    for depth in range(1, 7 if "**" in pattern else 2):
        own = pattern.replace("**", "/".join("*" * depth))
        parts = own.split("/")
        found = _listed(spark, own, lambda system, place, parts=parts: [x for x in system.globStatus(place) or () if seen(x, parts)])
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["path"])


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, name, size, modified`` of what a folder itself holds, files and folders, whose whole name matches a regular expression."""
    held = _listed(spark, path, lambda system, place: system.listStatus(place) if system.exists(place) else ())
    return held.where(full_match(F.col("name"), pattern))


def file_digest(spark: SparkSession, path: str, kind: str = "sha256") -> DataFrame:
    """``path, digest`` of the bytes of each file."""
    from .text import digest

    return spark.read.format("binaryFile").load(path).select("path", digest(F.col("content"), kind).alias("digest"))


def file_select(facts: DataFrame, formula: str, tests: dict[str, Column]) -> DataFrame:
    """Rows of file facts for which a formula over named tests holds."""
    from ..operators.guards import compile_guard

    return facts.where(compile_guard(formula, tests.__getitem__))


def new_lines(text: Column, offset: Column) -> Column:
    """``lines, offset, reset``: what a growing file has from a remembered offset (in bytes) on, as far as whole lines go.

    A file shorter than the offset was truncated and is read from its start.
    """
    reset = F.octet_length(text) < offset
    begin = F.when(reset, 0).otherwise(offset).cast("int")
    rest = F.substr(text.cast("binary"), begin + 1, F.octet_length(text) - begin).cast("string")
    whole = F.regexp_extract(rest, r"(?s)^(.*\n)", 1)
    lines = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(whole, r"\n$", ""), "\n"))
    return F.struct(lines.alias("lines"), (begin + F.octet_length(whole)).cast("long").alias("offset"), reset.alias("reset"))
