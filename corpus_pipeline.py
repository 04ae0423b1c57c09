"""A corpus pipeline of the text operators: documents in, token ids out."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from ruleloom.llm.exact import without_copies  # noqa: E402
from ruleloom.llm.jaccard import one_of_each  # noqa: E402
from ruleloom.llm.langid import accepted  # noqa: E402
from ruleloom.llm.mixing import mixed_rows  # noqa: E402
from ruleloom.llm.pieces import round_trips  # noqa: E402
from ruleloom.llm.storage import written  # noqa: E402


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; the others go."""
    return accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, shingle=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their targets."""
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    return round_trips(docs, with_ids=True)


STAGES = [
    ("language", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixture", mixture),
    ("token ids", token_ids),
]

#: Fitted centroids and lattice searches have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
