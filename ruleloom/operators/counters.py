"""Counts over rule bases and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.encode import CHUNK, CLASS, chunk_of
from ruleloom.functions.membership import class_index
from ruleloom.params import Params
from ruleloom.schema import RuleSchema, class_indices


def chunk_rule_counts(chunk_rules: DataFrame) -> DataFrame:
    """Rules per class in every chunk."""
    return chunk_rules.groupBy(CHUNK, CLASS).agg(F.count(F.lit(1)).alias("n_rules"))


def mean_rule_counts(chunk_rules: DataFrame, schema: RuleSchema, n_chunks: int) -> DataFrame:
    """Rules per class averaged over all chunks, those without rules included."""
    per_class = chunk_rules.groupBy(CLASS).agg(F.count(F.lit(1)).alias("n"))
    return (
        class_indices(chunk_rules.sparkSession, schema)
        .join(per_class, CLASS, "left")
        .select(
            CLASS,
            F.lit(n_chunks).alias("n_chunks"),
            (F.coalesce("n", F.lit(0)) / F.lit(n_chunks)).alias("mean_rules"),
        )
    )


def rules_per_class(rules: DataFrame) -> DataFrame:
    return rules.groupBy(CLASS).agg(F.count(F.lit(1)).alias("n_rules"))


def rule_base_size(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count(F.lit(1)).alias("n_rules"))


def chunk_class_counts(
    df: DataFrame, schema: RuleSchema, row_id: str, n_chunks: int, params: Params = Params()
) -> DataFrame:
    """Training rows per class in every chunk."""
    rows = df.select(
        chunk_of(df, row_id, n_chunks, params).alias(CHUNK),
        class_index(F.col(schema.label), schema.classes).alias(CLASS),
    )
    return rows.groupBy(CHUNK, CLASS).agg(F.count(F.lit(1)).alias("n_rows"))
