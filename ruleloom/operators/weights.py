"""Rule weights, the best class of a rule and the merge of chunk rule bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.membership import stable
from ruleloom.operators.encode import CHUNK, CLASS, antecedents_of


def class_weights(support: DataFrame, rule_weight: str, group=(CHUNK,)) -> DataFrame:
    """Weight of every class seen with a rule: its share of the rule's support.

    ``pcf`` subtracts the share of the other seen classes. Rules no row supports
    are left out before dividing.
    """
    own = F.col("support")
    total = F.sum("support").over(Window.partitionBy(*group, "rule_key"))
    t = F.col("total")
    weight = own / t if rule_weight == "cf" else (own - (t - own)) / t
    return (
        support.withColumn("total", total)
        .filter(t > 0)
        .withColumn("weight", stable(weight))
        .drop("support", "total")
    )


def best_class(weighted: DataFrame, group=(CHUNK,)) -> DataFrame:
    """Heaviest class per rule, the lowest index on a tie; weight must be > 0."""
    best = weighted.groupBy(*group, "rule_key").agg(
        F.max(F.struct(F.col("weight"), (-F.col(CLASS)).alias("c"))).alias("b")
    )
    return best.select(
        *group, "rule_key", (-F.col("b.c")).alias(CLASS), F.col("b.weight").alias("weight")
    ).filter(F.col("weight") > 0)


def first_class(candidates: DataFrame, group=(CHUNK,)) -> DataFrame:
    """Weightless rules: the class of the first row that suggests the rule."""
    return candidates.groupBy(*group, "rule_key").agg(
        F.min_by(CLASS, "first_row").alias(CLASS), F.lit(1.0).alias("weight")
    )


def merge_rules(rules: DataFrame, by=()) -> DataFrame:
    """Merge chunk rule bases: mean weight per (rule, class), heaviest class wins.

    A mean is a partial aggregate, so chunks are combined on the map side first.
    """
    by = list(by)
    mean = rules.groupBy(*by, "rule_key", CLASS).agg(stable(F.avg("weight")).alias("weight"))
    return best_class(mean, by)


def finish_rules(rules: DataFrame, by=()) -> DataFrame:
    return rules.select(*by, "rule_key", antecedents_of(F.col("rule_key")).alias("antecedents"), CLASS, "weight")


def keep_rules(rules: DataFrame, kept: DataFrame, on=(CHUNK, "rule_key")) -> DataFrame:
    """The rules named in ``kept``."""
    return rules.join(kept.select(*on).distinct(), list(on), "left_semi")
