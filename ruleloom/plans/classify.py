"""Score a table with a model and report the usual results in one go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ruleloom.operators.evaluate import accuracy, binary_auc, confusion_matrix, confusion_pivot
from ruleloom.plans.learn import Model
from ruleloom.session import cut_lineage


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame
    matrix: DataFrame
    pivot: DataFrame
    auc: DataFrame
    accuracy: DataFrame


def classify(model: Model, df: DataFrame, row_id: str | None = None, positive: int = 0) -> Evaluation:
    """Predictions and, from one small matrix, the pivot, AUC and accuracy.

    The matrix is worked out once and kept in the checkpoint folder.
    """
    predictions = model.predict(df, row_id)
    matrix = cut_lineage(confusion_matrix(predictions, model.schema))
    return Evaluation(
        predictions, matrix, confusion_pivot(matrix, model.schema), binary_auc(matrix, positive), accuracy(matrix)
    )
