"""Readable text for rules, variables, classes and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.membership import pick
from ruleloom.operators.encode import CLASS
from ruleloom.operators.ranking import numbered
from ruleloom.schema import RuleSchema

# The wording of the text outputs, which other tools read.
LABEL_PREFIX = "L_"
TERM = " IS "
AND = " AND "
RULE = "IF {terms} THEN CLASS = {cls} WITH RW = {weight}"
RULE_LINE = "Rule ({number}): {rule}"
RULE_BASE_HEAD = "RULE BASE: ({size})"
KNOWLEDGE_HEAD = "DATABASE"
CLASS_HEAD = "Class:"
RATIO_HEAD = "IR:"
MATRIX_COLUMN = "Prediction "
MATRIX_ROW = "Class "
COUNTER_HEAD = " Average of RB in each Map with total Map = "
FOLDS_HEAD = " Number of iterations = "
MEAN_HEAD = " Average AUC = "


def term_texts(schema: RuleSchema, antecedents: Column) -> list[Column]:
    """``name IS label`` for every feature of a rule."""
    out = []
    for i, v in enumerate(schema.variables):
        at = F.get(antecedents, F.lit(i))
        if v.is_numeric:
            value = F.concat(F.lit(LABEL_PREFIX), at.cast("string"))
        else:
            value = at.cast("string") if v.size else pick(v.values, at)
        out.append(F.concat(F.lit(v.name + TERM), value))
    return out


def rule_text(schema: RuleSchema, antecedents: Column, class_idx: Column, weight: Column) -> Column:
    head, rest = RULE.split("{terms}")
    middle, rest = rest.split("{cls}")
    last = rest.split("{weight}")[0]
    return F.concat(
        F.lit(head),
        F.concat_ws(AND, *term_texts(schema, antecedents)),
        F.lit(middle),
        pick(schema.classes, class_idx),
        F.lit(last),
        weight.cast("string"),
    )


def compact_rule(antecedents: Column, class_idx: Column, weight: Column) -> Column:
    """``a1 … an class weight`` separated by blanks."""
    return F.concat_ws(
        " ", F.array_join(antecedents, " "), class_idx.cast("string"), weight.cast("string")
    )


def rule_lines(rules: DataFrame, schema: RuleSchema) -> DataFrame:
    """``(rule_no, line)`` of the readable rule base."""
    text = rule_text(schema, F.col("antecedents"), F.col(CLASS), F.col("weight"))
    a, b = RULE_LINE.split("{number}")
    b = b.split("{rule}")[0]
    line = F.concat(F.lit(a), F.col("rule_no").cast("string"), F.lit(b), text)
    return numbered(rules, ["antecedents"], "rule_no").select("rule_no", line.alias("line"))


def compact_lines(rules: DataFrame) -> DataFrame:
    return rules.select(compact_rule(F.col("antecedents"), F.col(CLASS), F.col("weight")).alias("value"))


def variable_lines(schema: RuleSchema, sets: DataFrame) -> DataFrame:
    """``(var_idx, text)``: the triangles of numeric, the values of nominal variables."""
    spark = sets.sparkSession
    triangle = F.concat(
        F.lit(" " + LABEL_PREFIX),
        F.col("label").cast("string"),
        F.lit(": ("),
        F.concat_ws(",", *[F.col(c).cast("string") for c in ("left_pt", "mid_pt", "right_pt")]),
        F.lit(")\n"),
    )
    numeric = (
        sets.withColumn("t", triangle)
        .groupBy("var_idx", "name")
        .agg(F.array_sort(F.collect_list(F.struct("label", "t"))).alias("t"))
        .select(
            "var_idx",
            F.concat(F.col("name"), F.lit(":\n"), F.array_join(F.transform("t", lambda e: e["t"]), "")).alias("text"),
        )
    )
    nominal = [
        (i, f"{v.name} (nominal variable):\nNominal values: {', '.join(v.values) or f'codes 0 to {v.n_values - 1}'}\n")
        for i, v in enumerate(schema.variables)
        if not v.is_numeric
    ]
    if not nominal:
        return numeric
    return numeric.unionByName(spark.createDataFrame(nominal, "var_idx int, text string"))


def class_lines(schema: RuleSchema) -> str:
    ratios = ", ".join(repr(float(r)) for r in schema.imbalance_ratios())
    return f"\n{CLASS_HEAD}\n {', '.join(schema.classes)}\n\n{RATIO_HEAD}\n {ratios}\n"
