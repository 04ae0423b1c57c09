"""Confusion matrix, AUC, accuracy and fold averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.schema import RuleSchema


def confusion_matrix(predictions: DataFrame, schema: RuleSchema | None = None, by=()) -> DataFrame:
    """``(by, actual, predicted, n)``; with a schema, cells without rows are 0.

    Counted on the map side first: at most classes x classes rows are shuffled
    per task.
    """
    by = list(by)
    counts = predictions.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    if schema is None:
        return counts
    k = len(schema.classes)
    # All cells of each group with 0, added to what was counted.
    every = f"sequence(0, {k - 1})"
    zeros = f"flatten(transform({every}, a -> transform({every}, p -> named_struct('actual', a, 'predicted', p, 'n', 0L))))"
    packed = counts.groupBy(*by).agg(F.collect_list(F.expr("named_struct('actual', actual, 'predicted', predicted, 'n', n)")).alias("c"))
    cells = packed.selectExpr(*by, f"inline(concat(c, {zeros}))")
    return cells.groupBy(*by, "actual", "predicted").agg(F.sum("n").alias("n"))


def confusion_pivot(matrix: DataFrame, schema: RuleSchema) -> DataFrame:
    """One row per actual class, one column ``pred_<i>`` per predicted class."""
    k = len(schema.classes)
    wide = matrix.groupBy("actual").pivot("predicted", list(range(k))).agg(F.sum("n"))
    return wide.select("actual", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"pred_{i}") for i in range(k)])


def binary_auc(matrix: DataFrame, positive: int = 0, by=(), undefined=None) -> DataFrame:
    """``(1 + TPR - FPR) / 2`` for one class against the rest.

    Undefined rates (a class without rows) give null, or ``undefined`` in place
    of the missing rate.
    """
    pos, hit = F.col("actual") == positive, F.col("predicted") == positive
    n = F.col("n")

    def total(cond):
        return F.sum(F.when(cond, n).otherwise(0))

    sums = matrix.groupBy(*by).agg(
        total(pos & hit).alias("tp"),
        total(pos & ~hit).alias("fn"),
        total(~pos & hit).alias("fp"),
        total(~pos & ~hit).alias("tn"),
    )
    tpr = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    fpr = F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))
    if undefined is not None:
        tpr, fpr = F.coalesce(tpr, F.lit(float(undefined))), F.coalesce(fpr, F.lit(float(undefined)))
    return sums.select(*by, "tp", "fn", "fp", "tn", ((F.lit(1.0) + tpr - fpr) / 2.0).alias("auc"))


def accuracy(matrix: DataFrame, by=()) -> DataFrame:
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.groupBy(*by).agg(
        hits.alias("hits"), F.sum("n").alias("total"), F.try_divide(hits, F.sum("n")).alias("accuracy")
    )


def mean_auc(fold_metrics: DataFrame, by=()) -> DataFrame:
    """Mean AUC over folds and how many folds there were."""
    return fold_metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), F.avg("auc").alias("mean_auc"))
