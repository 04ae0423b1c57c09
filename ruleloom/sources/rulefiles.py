"""Compact rule files: ``a1 … an class weight`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.encode import CLASS
from ruleloom.schema import RuleSchema


def parse_compact(lines: DataFrame, schema: RuleSchema) -> DataFrame:
    """Rules from lines (column ``value``)."""
    n = len(schema.variables)
    parts = F.split(F.trim("value"), r"\s+")
    return (
        lines.select(parts.alias("p"))
        .filter(F.size("p") == n + 2)
        .select(
            F.array_join(F.slice("p", 1, n), "|").alias("rule_key"),
            F.slice("p", 1, n).cast("array<int>").alias("antecedents"),
            F.element_at("p", n + 1).cast("int").alias(CLASS),
            F.element_at("p", n + 2).cast("double").alias("weight"),
        )
    )


def read_compact_rules(spark: SparkSession, path, schema: RuleSchema) -> DataFrame:
    """Read a compact rule file back; the file stays where it is."""
    return parse_compact(spark.read.text(path), schema)
