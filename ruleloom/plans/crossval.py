"""Cross-validation in one pass over the rows.

Degree sums are additive, so the sums of every fold are taken once and a fold's
training set is the sum over the other folds. All fold models come out of one
scan. A cell's entries of all fold models stand in one row of the cell table, so
a row meets its cell once and is scored by as many models as are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.encode import CHUNK, CLASS, chunk_of, encode, own_labels, rule_key
from ruleloom.operators.evaluate import binary_auc, confusion_matrix, mean_auc
from ruleloom.operators.grid import Grid
from ruleloom.operators.score import score, score_models
from ruleloom.operators.support import cell_sums, corner_support, with_costs
from ruleloom.operators.weights import best_class, class_weights, first_class, merge_rules
from ruleloom.params import Params
from ruleloom.plans.learn import learn
from ruleloom.schema import RuleSchema
from ruleloom.sources.folds import fold_of

FOLD = "fold"


@dataclass(frozen=True)
class CrossValidation:
    """Rules of every fold model, test and training predictions, and metrics.

    A model is named by the fold it leaves out.
    """

    schema: RuleSchema
    rules: DataFrame
    test: DataFrame
    train: DataFrame

    def matrix(self, which: str = "test") -> DataFrame:
        return confusion_matrix(getattr(self, which), self.schema, [FOLD])

    def metrics(self, which: str = "test") -> DataFrame:
        return binary_auc(self.matrix(which), by=[FOLD])

    def average(self, which: str = "test") -> DataFrame:
        return mean_auc(self.metrics(which))


def other_folds(df: DataFrame, n_folds: int) -> DataFrame:
    """Each row once per fold it does not belong to."""
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda m: m != F.col(FOLD))
    return df.withColumn("__m", F.explode(others)).drop(FOLD).withColumnRenamed("__m", FOLD)


def fold_rules(df: DataFrame, schema: RuleSchema, params: Params, row_id: str, own: bool = False) -> DataFrame:
    """``(fold, rule_key, class_idx, weight)``: the rule base without each fold.

    ``df`` has a ``fold`` column. With ``own`` a fold's rows are its training rows.
    """
    k, group = params.n_folds, [FOLD, CHUNK]

    def training(table):
        return table if own else other_folds(table, k)

    if params.n_evaluations > 0 or (params.rule_weight != "none" and not Grid(schema).is_small):
        # Selection and wide tables have no additive sums: one run per fold.
        one = replace(params, n_folds=0)
        parts = [
            learn(df.filter(F.col(FOLD) == i if own else F.col(FOLD) != i), schema, one, row_id).rules.withColumn(FOLD, F.lit(i))
            for i in range(k)
        ]
        return reduce(DataFrame.unionByName, parts).select(FOLD, "rule_key", CLASS, "weight")
    cols = [F.col(FOLD), chunk_of(df, row_id, params.n_chunks, params).alias(CHUNK)]
    if params.rule_weight == "none":
        rows = encode(df, schema, [*cols, F.col(row_id).alias("row_id")], params.bad_rows)
        seen = rows.select(*group, CLASS, rule_key(own_labels(schema)).alias("rule_key"), "row_id")
        firsts = seen.groupBy(*group, "rule_key", CLASS).agg(F.min("row_id").alias("first_row"))
        local = first_class(training(firsts), group)
    else:
        rows = encode(df, schema, cols, params.bad_rows)
        cells = training(cell_sums(rows, schema, group, params.weight_features))
        sums = corner_support(cells, schema, group, params.weight_features)
        local = best_class(class_weights(with_costs(sums, schema, params), params.rule_weight, group), group)
    if params.n_chunks == 1:
        return local.select(FOLD, "rule_key", CLASS, "weight")
    return merge_rules(local, [FOLD]).select(FOLD, "rule_key", CLASS, "weight")


def cross_validate(
    df: DataFrame, schema: RuleSchema, params: Params, row_id: str, fold=None
) -> CrossValidation:
    """Learn without each fold, score each fold (test) and the rest (train).

    ``fold`` is a column numbering folds from 0; by default the row id gives it.
    Ranges and class sizes are those of the whole schema. Chunk and fold by the
    id modulo numbers with a common divisor would leave a model without some of
    its chunks, so that is refused.
    """
    k = params.n_folds
    if k < 2:
        raise ValueError("n_folds must be at least 2")
    if fold is None and params.assign == "id" and gcd(params.n_chunks, k) > 1:
        raise ValueError("n_chunks and n_folds have a common divisor: use assign='digest' or a fold column")
    rows = df.withColumn(FOLD, fold if fold is not None else fold_of(df, row_id, k, params))
    rules = fold_rules(rows, schema, params, row_id)
    if Grid(schema).is_small:
        others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda m: m != F.col(FOLD))
        test, train = (
            score_models(rows, schema, rules, params, row_id, FOLD, k, models)
            for models in (F.array(FOLD), others)
        )
        return CrossValidation(schema, rules, test, train)

    def run(table):
        return score(table, schema, rules, params, row_id, keep=[FOLD], group=[FOLD], n_groups=k)

    return CrossValidation(schema, rules, run(rows), run(other_folds(rows, k)))


def validate_files(pairs, schema: RuleSchema, params: Params) -> DataFrame:
    """Metrics over separate (training, test) tables, one pair per fold."""
    out = []
    for i, (train, test) in enumerate(pairs):
        model = learn(train, schema, replace(params, n_folds=0), "row_id")
        for which, table in (("test", test), ("train", train)):
            matrix = confusion_matrix(model.predict(table, "row_id"), schema)
            out.append(binary_auc(matrix).select(F.lit(i).alias(FOLD), F.lit(which).alias("part"), "tp", "fn", "fp", "tn", "auc"))
    return reduce(DataFrame.unionByName, out)


def validate_folds(rows: DataFrame, schema: RuleSchema, params: Params, row_id: str = "row_id") -> DataFrame:
    """``(fold, part, tp, fn, fp, tn, auc)`` over a table with columns ``fold`` and ``part`` (train or test).

    All folds are learned in one pass and scored in one more; a test row need not be a training row of another fold.
    """
    rules = fold_rules(rows.filter(F.col("part") == "train"), schema, params, row_id, own=True)
    by = [FOLD, "part"]
    found = score(rows, schema, rules, params, row_id, keep=by, group=[FOLD], n_groups=params.n_folds)
    return binary_auc(confusion_matrix(found, schema, by), by=by).select(*by, "tp", "fn", "fp", "tn", "auc")
