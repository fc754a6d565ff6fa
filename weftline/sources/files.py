"""Tuple files, CSV, JSON, separated text, snapshots and graph files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_TUPLE = r"^\(([^,]*),([^,]*),([^,]*),([^,]*),([^,]*),([^,)]*)\)\s*$"
NAMES = ["src", "atype", "fwd", "dst", "bwd", "context"]


def parse_tuples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tuples of lines that begin with a parenthesis. Malformed ones are left out, one by one; see :func:`malformed_tuples`."""
    line = F.col(column)
    good = lines.where(line.startswith("(") & line.rlike(_TUPLE))
    parts = [F.regexp_extract(line, _TUPLE, i + 1) for i in range(6)]
    return good.select(*[(p.try_cast("int") if n == "atype" else p).alias(n) for n, p in zip(NAMES, parts, strict=True)])


def malformed_tuples(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.where(F.col(column).startswith("(") & ~F.col(column).rlike(_TUPLE))


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    return parse_tuples(spark.read.text(path))


def tuple_line() -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", *NAMES), F.lit(")"))


def write_tuples(tuples: DataFrame, path: str) -> None:
    tuples.select(tuple_line().alias("value")).write.text(path)


def cypher(src: Column, dst: Column, relation: Column) -> Column:
    """One MERGE statement per tuple; quotes are escaped."""
    quote = lambda c: F.regexp_replace(c, "'", "\\\\\\\\'")
    return F.format_string("MERGE (a:Concept {name:'%s'}) MERGE (b:Concept {name:'%s'}) MERGE (a)-[:%s]->(b)", quote(src), quote(dst), F.upper(F.regexp_replace(relation, "[^A-Za-z0-9]", "_")))


def posted_tuple(body: Column) -> Column:
    """A tuple line out of a percent-encoded request body."""
    return F.try_url_decode(body)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields may hold commas, doubled quotes and line breaks; all fields are strings."""
    return spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, quote='"', escape='"')


def csv_line(*columns: Column) -> Column:
    """Fields with a quote, comma or line break are quoted, quotes doubled."""
    one = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *map(one, columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def string_array(text: Column, comment: str, separator: str) -> Column:
    """Map of a line's first field to its other fields; comments and empty lines are left out, later keys win."""
    rows = F.filter(F.split(F.regexp_replace(text, comment, ""), "\n"), lambda x: F.trim(x) != "")
    split = F.transform(rows, lambda x: F.split(x, separator))
    entries = F.transform(split, lambda f: F.struct(f[0].alias("key"), F.slice(f, 2, F.size(f)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def string_list(text: Column, comment: str, separator: str, most: int) -> Column:
    return F.slice(F.filter(F.split(F.regexp_replace(text, comment, ""), separator), lambda x: x != ""), 1, most)


def latest(snapshot: DataFrame, key: list[str], *order: str) -> DataFrame:
    """A key-value store out of its writes: the last row of each key by ``order``, later columns breaking ties. The window keeps one row per key and task before the shuffle."""
    w = W.partitionBy(*key).orderBy(*map(F.desc, order))
    return snapshot.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unexpired(snapshot: DataFrame, last_seen: str, now: Column, ttl_seconds: int) -> DataFrame:
    return snapshot.where(F.col(last_seen) >= now - ttl_seconds)


def converge(table: DataFrame, wanted: DataFrame, key: list[str], value: str) -> DataFrame:
    """Convergent upsert: wanted rows win, and ``action`` tells insert, update or keep."""
    t, w = table.select(*key, F.col(value).alias("_old")), wanted.select(*key, F.col(value).alias("_new"), F.lit(1).alias("_w"))
    both = t.withColumn("_t", F.lit(1)).join(w, key, "full_outer")
    action = F.when(F.col("_t").isNull(), "insert").when(F.col("_w").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("keep")
    return both.select(*key, F.when(F.col("_w").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias(value), action.alias("action"))


def write_graph(series: DataFrame, path: str) -> None:
    series.write.partitionBy("observable").csv(path)
