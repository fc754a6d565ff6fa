"""A corpus pipeline over ``documents``: each stage works on all that the one before kept.

Stages take ``(spark, docs, sf_dir)``; what one returns is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, jaccard, langid, mixing, secrets
from weftline.llm.common import fresh_path, ship

#: A document whose language is less sure than this is rejected, besides those without any.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: no text, no letter, or an undecided posterior.

    Null and empty texts go; nulls elsewhere, very long texts, repeated rows and columns
    of any name stay as they are; an empty table gives no rows.
    """
    ship(spark)
    return langid.recognised(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents linked by a similarity of 0.8 of five-word shingles.

    Empty texts and null ids stay, each alone; rows that repeat a kept id stay; columns of
    any name stay as they are; an empty table gives no rows.
    """
    ship(spark)
    return jaccard.deduplicate(docs, percent=80, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts and null ids stay; repeated rows stay or go together; columns of
    any name stay as they are; an empty table, or an empty benchmark, drops nothing.
    """
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live secrets in the texts and counts ``n_chars`` anew there; every document stays.

    Null and empty texts stay; repeated rows are changed alike; other columns of any name
    stay as they are; an empty table gives no rows.
    """
    ship(spark)
    return secrets.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's domain and fitted rate, and drops those whose rate is zero.

    The two columns are ``domain`` and ``rate``, lengthened by ``_`` where documents have
    such columns of their own. Empty texts move no total and keep their rate; repeated rows
    are treated alike; without labels all domains are equally likely; an empty table gives no rows.
    """
    ship(spark)
    return mixing.sampled_at(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing to target weights", mix_to_targets),
]
#: SQL can't express the first and last stages; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
