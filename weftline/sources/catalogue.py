"""Tables of a session or of a database beyond it: listing, columns, definitions that converge, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A query of an external database; with a numeric key and its bounds it is read in parts."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, v)
    if key and bounds:
        reader = reader.option("dbtable", f"({query}) t").option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    else:
        reader = reader.option("query", query)
    return reader.load()


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def columns(df: DataFrame) -> DataFrame:
    """``place, name, type`` of the columns of a table."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "place long, name string, type string")


def definitions(text: list[str]) -> dict[str, tuple[str, int | None]]:
    """Column definitions of the form ``name,type[,size]``."""
    out = {}
    for line in text:
        name, kind, *size = [x.strip() for x in line.split(",")]
        out[name] = (kind.lower(), int(size[0]) if size else None)
    return out


# Names of types in definitions and Spark's own.
TYPES = {"int": "int", "integer": "int", "long": "bigint", "bigint": "bigint", "real": "double", "double": "double", "text": "string", "varchar": "string", "string": "string", "timestamp": "timestamp_ntz"}


def compared(df: DataFrame, wanted: list[str]) -> DataFrame:
    """``name, state`` of each column that a table has or should have: ``same``, ``differs``, ``missing`` or ``extra``."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = definitions(wanted)
    rows = [(n, "missing" if n not in have else "same" if TYPES.get(k, k) == have[n] else "differs") for n, (k, _) in want.items()]
    rows += [(n, "extra") for n in have if n not in want]
    return df.sparkSession.createDataFrame(rows, "name string, state string")


def converged(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The table with its missing columns added as nulls and those that differ cast; extra columns stay."""
    out = df
    for name, (kind, _) in definitions(wanted).items():
        kind = TYPES.get(kind, kind)
        out = out.withColumn(name, F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind))
    return out


def create(spark: SparkSession, name: str, wanted: list[str]) -> None:
    """A table with the defined columns, unless it is there; missing columns are added."""
    fields = ", ".join(f"{n} {TYPES.get(k, k)}" for n, (k, _) in definitions(wanted).items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet")
    missing = [n for n in definitions(wanted) if n not in spark.table(name).columns]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'{n} {TYPES.get(definitions(wanted)[n][0], definitions(wanted)[n][0])}' for n in missing)})")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def empty(spark: SparkSession, wanted: list[str]) -> DataFrame:
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType()}
    return spark.createDataFrame([], T.StructType([T.StructField(n, kinds[TYPES.get(k, k)]) for n, (k, _) in definitions(wanted).items()]))
