"""Why rows don't take part: counts per reason in one scan, or metrics beside a job that runs anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.functions.membership import class_index, nominal_label
from ruleloom.operators.encode import all_finite, quoted
from ruleloom.schema import RuleSchema
from ruleloom.sources.examples import split_fields

REASONS = ("fields", "class", "number", "value", "kept")


def fault(df: DataFrame, schema: RuleSchema, fits: Column | None = None) -> Column:
    """The first reason of REASONS that holds for a row; ``kept`` if nothing is wrong.

    ``class`` and ``value`` are a label or nominal value that the schema doesn't know,
    ``number`` is a null, unreadable or infinite feature, ``fields`` a line for which
    ``fits`` is false.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = []
    for i in schema.numeric_positions:
        name = schema.variables[i].name
        cast = "try_cast" if isinstance(types[name], T.StringType) else "CAST"
        numbers.append(f"{cast}({quoted(name)} AS DOUBLE)")
    known = F.coalesce(class_index(F.col(quoted(schema.label)), schema.classes), F.lit(-1)) >= 0
    reason = F.when(~known, "class") if fits is None else F.when(~fits, "fields").when(~known, "class")
    if numbers:
        reason = reason.when(~F.expr(all_finite(numbers)), "number")
    for i in schema.nominal_positions:
        var = schema.variables[i]
        reason = reason.when(F.coalesce(nominal_label(F.col(quoted(var.name)), var), F.lit(-1)) < 0, "value")
    return reason.otherwise("kept")


def drop_counts(df: DataFrame, schema: RuleSchema) -> DataFrame:
    """``(reason, n)`` over the rows of a table."""
    return df.groupBy(fault(df, schema).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def line_drop_counts(lines: DataFrame, schema: RuleSchema) -> DataFrame:
    """``(reason, n)`` over example lines (column ``value``)."""
    names = schema.file_columns
    split = lines.select(split_fields(F.col("value")).alias("__f"))
    fields = split.select((F.size("__f") == len(names)).alias("__fits"), *[F.get("__f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return fields.groupBy(fault(fields, schema, F.col("__fits")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def watched(df: DataFrame, schema: RuleSchema, observation) -> DataFrame:
    """``df`` as it is; the next action on it fills ``observation`` with a count per reason, without a pass of its own."""
    reason = fault(df, schema)
    return df.observe(observation, *[F.count_if(reason == r).alias(r) for r in REASONS[1:]])
