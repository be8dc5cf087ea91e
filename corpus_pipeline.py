"""Corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, then the mix in training order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import curriculum, decontaminate, deobfuscate, ngram_join, quality
from wardline.llm.shared import cut, documents, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.scored(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of least id, rows without an id after all others; documents without words are no one's copies.

    Rows are told apart by id and text: null ids are copies like others, and a unique text stays though its id repeats. Of rows that
    repeat both, one stays.
    """
    return ngram_join.one_of_each(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; items of fewer than `decontaminate.LEAST_REMOVED` words remove none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every identifier, plain or disguised, replaced by its kind; n_chars follows."""
    text = F.coalesce("redacted", "text")
    found = deobfuscate.scan(docs).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def training_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in order of its training position."""
    own = ["size", "target", "taken"]
    return curriculum.training_order(curriculum.mix(docs), [*(c for c in docs.columns if c not in own), *own])


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", no_leaks),
    ("personal_data", no_personal_data),
    ("mix", training_mix),
]

#: The stages hold trained models and similarity groups, which SQL cannot state; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
