"""Readable outputs: rule base, variables, matrix, counters and fold averages.

Every writer builds a DataFrame of lines and hands it to Spark's text writer;
the ``*_text`` functions return those lines so they can be shown or checked.
Lines carry an order column and are sorted by range, so large rule bases are
written by many tasks into files whose names keep the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import rendering as R
from ruleloom.functions.membership import pick
from ruleloom.operators.evaluate import mean_auc
from ruleloom.plans.learn import Model
from ruleloom.schema import RuleSchema, fuzzy_sets_table


def _write(lines: DataFrame, path: str, mode: str) -> None:
    lines.orderBy("at").select("value").write.mode(mode).text(path)


def rule_base_text(rules: DataFrame, schema: RuleSchema) -> DataFrame:
    """``(at, value)``: a head with the size, then one numbered rule per line."""
    spaced = R.rule_lines(rules, schema).select(
        F.col("rule_no").cast("bigint").alias("at"), F.concat(F.col("line"), F.lit("\n")).alias("value")
    )
    before, after = R.RULE_BASE_HEAD.split("{size}")
    size = F.count(F.lit(1)).cast("string")
    head = rules.agg(F.concat(F.lit("\n" + before), size, F.lit(after + "\n")).alias("value"))
    return head.select(F.lit(-1).cast("bigint").alias("at"), "value").unionByName(spaced)


def variables_text(schema: RuleSchema, spark) -> DataFrame:
    """``(at, value)``: variables, class labels and imbalance ratios."""
    lines = R.variable_lines(schema, fuzzy_sets_table(spark, schema))
    lines = lines.select(F.col("var_idx").cast("bigint").alias("at"), F.col("text").alias("value"))
    tail = spark.createDataFrame([(len(schema.variables), R.class_lines(schema))], "at bigint, value string")
    return lines.unionByName(tail)


def confusion_text(pivot: DataFrame, schema: RuleSchema) -> DataFrame:
    """``(at, value)``: tab-separated, one row per actual class."""
    head = "\t".join(["", *[R.MATRIX_COLUMN + c for c in schema.classes]])
    name = F.concat(F.lit(R.MATRIX_ROW), pick(schema.classes, F.col("actual")))
    cells = [F.col(f"pred_{i}").cast("string") for i in range(len(schema.classes))]
    rows = pivot.select(F.col("actual").cast("bigint").alias("at"), F.concat_ws("\t", name, *cells).alias("value"))
    top = pivot.sparkSession.createDataFrame([(-1, head)], "at bigint, value string")
    return top.unionByName(rows)


def counters_text(means: DataFrame, schema: RuleSchema) -> DataFrame:
    """``(at, value)``: mean rules per class over the chunks."""
    head = means.agg(F.concat(F.lit(R.COUNTER_HEAD), F.first("n_chunks").cast("string")).alias("value"))
    rows = means.select(
        F.col("class_idx").cast("bigint").alias("at"),
        F.concat(
            F.lit(" " + R.MATRIX_ROW),
            pick(schema.classes, F.col("class_idx")),
            F.lit(" = "),
            F.col("mean_rules").cast("string"),
        ).alias("value"),
    )
    return head.select(F.lit(-1).cast("bigint").alias("at"), "value").unionByName(rows)


def folds_text(metrics: DataFrame) -> DataFrame:
    """``(at, value)``: how many folds and their mean AUC."""
    value = F.concat(
        F.lit(R.FOLDS_HEAD),
        F.col("n_folds").cast("string"),
        F.lit("\n" + R.MEAN_HEAD),
        F.col("mean_auc").cast("string"),
    )
    return mean_auc(metrics).select(F.lit(0).cast("bigint").alias("at"), value.alias("value"))


def knowledge_text(model: Model, spark) -> DataFrame:
    """``(at, value)``: variables, then the rules."""
    top = spark.createDataFrame([(-(2**40), R.KNOWLEDGE_HEAD)], "at bigint, value string")
    variables = R.variable_lines(model.schema, fuzzy_sets_table(spark, model.schema)).select(
        (F.col("var_idx") - 2**39).alias("at"), F.col("text").alias("value")
    )
    rules = rule_base_text(model.rules, model.schema).filter(F.col("at") >= 0)
    return top.unionByName(variables).unionByName(rules)


def write_rule_base(model: Model, path: str, mode: str = "errorifexists") -> None:
    _write(rule_base_text(model.rules, model.schema), path, mode)


def write_compact_rules(rules: DataFrame, path: str, mode: str = "errorifexists") -> None:
    R.compact_lines(rules).write.mode(mode).text(path)


def write_variables(schema: RuleSchema, spark, path: str, mode: str = "errorifexists") -> None:
    _write(variables_text(schema, spark), path, mode)


def write_confusion_matrix(pivot: DataFrame, schema: RuleSchema, path: str, mode: str = "errorifexists") -> None:
    _write(confusion_text(pivot, schema), path, mode)


def write_counters(means: DataFrame, schema: RuleSchema, path: str, mode: str = "errorifexists") -> None:
    _write(counters_text(means, schema), path, mode)


def append_fold_metrics(metrics: DataFrame, path: str) -> None:
    """Add fold metrics to a table that grows fold by fold; a fold written again replaces its earlier rows."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def write_fold_average(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write(folds_text(metrics), path, mode)


def write_knowledge_base(model: Model, spark, path: str, mode: str = "errorifexists") -> None:
    _write(knowledge_text(model, spark), path, mode)
