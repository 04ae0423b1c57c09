"""Numbering the rows of a large table in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.session import cut_lineage

PART, AT = "__part", "__at"
#: Fixed value: the low bits of a row id of Spark count rows within a partition.
WITHIN = (1 << 33) - 1


def ordered_parts(df: DataFrame, order) -> DataFrame:
    """``df`` sorted by range, written once, with the number of its range and the place in it."""
    spread = df.orderBy(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN))
    return cut_lineage(spread.withColumns({PART: F.spark_partition_id(), AT: place}))


def numbered(df: DataFrame, order, name: str, group=()) -> DataFrame:
    """``df`` with ``name``, the place from 0 of each row in ``order`` within ``group``.

    Rows are parted by ranges of (group, order), so a group that holds most of the rows
    spreads over many tasks. A window adds up the sizes of ranges only, one row per range
    and group. Rows that ``order`` doesn't tell apart get places of their own.
    """
    group = list(group)
    rows = ordered_parts(df, [*group, *order])
    sizes = rows.groupBy(*group, PART).agg(F.count(F.lit(1)).alias("__n"), F.min(AT).alias("__low"))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, PART, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__start"))
    return (
        rows.join(starts, [*group, PART]).withColumn(name, F.col("__start") + F.col(AT)).drop(PART, AT, "__start")
    )
