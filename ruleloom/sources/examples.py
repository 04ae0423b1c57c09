"""Comma-separated example files without a header row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.schema import RuleSchema


def split_fields(line: Column) -> Column:
    """Fields of a line: blanks removed, trailing empty fields not counted."""
    text = F.regexp_replace(F.replace(line, F.lit(" "), F.lit("")), ",+$", "")
    return F.split(text, ",")


def split_examples(lines: DataFrame, schema: RuleSchema, observation=None, keep=()) -> DataFrame:
    """Lines (column ``value``) to text columns in the schema's file order.

    Lines with another number of fields are dropped. Pass an ``Observation`` to
    learn how many: it reports ``read`` and ``dropped`` after the first action,
    without a pass of its own. ``row_id`` follows the file layout, so use it for
    chunks or tie order only while the files stay as they are. ``keep`` names
    further columns of ``lines`` that stay.
    """
    width = len(schema.variables) + 1
    fields = lines.select(split_fields(F.col("value")).alias("f"), F.monotonically_increasing_id().alias("row_id"), *keep)
    fits = F.size("f") == width
    if observation is not None:
        fields = fields.observe(
            observation, F.count(F.lit(1)).alias("read"), F.count_if(~fits).alias("dropped")
        )
    names = schema.file_columns
    return fields.filter(fits).select("row_id", *keep, *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_examples(spark: SparkSession, path, schema: RuleSchema, observation=None) -> DataFrame:
    """Read example files. Columns are text; numbers are read when encoded."""
    return split_examples(spark.read.text(path), schema, observation)
