"""One query for each operator, over whole standard tables with production parameters.

Four have SQL for DuckDB (``oracles``). The others can't be said in it: they are tested
against a brute-force version, an exact round trip or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_text, jaccard, langid, mixing, repeats, secrets, suffix_tree, warc
from .common import doc_number, ship
from .oracles import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(doc_number(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"))
    model = langid.fit(docs.where("doc_id is not null and not held_out"))
    return langid.predict(docs, model, carry=["doc_id", "held_out"])


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_number(F.col("doc_id")) % 10 == 0
    return suffix_tree.scores(table(spark, sf_dir, "documents"), ~held_out, held_out)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), percent=85, size=4)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_chunks, op2_language_id, op3_projection_forest, op4_html_text, op5_suffix_tree, op6_decontamination, op7_mixing, op8_jaccard_join, op9_secrets, op10_repeats)}
