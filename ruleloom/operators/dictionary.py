"""Long value lists as tables.

A nominal column with many values has a dictionary ``(value, code)`` that Spark builds by
ranges and joins to rows; the driver knows its size only. Learning and scoring then see
codes, see ``size`` of :class:`ruleloom.schema.Variable`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.operators.encode import quoted
from ruleloom.operators.ranking import numbered
from ruleloom.params import Params
from ruleloom.session import cut_lineage

ENTRY_BYTES = 32


@dataclass(frozen=True)
class Dictionary:
    """The values of a column, coded from 0 in order, and how much they are."""

    column: str
    table: DataFrame
    size: int
    n_bytes: int


def dictionary(df: DataFrame, column: str) -> Dictionary:
    """All non-null values of a column. Copies are dropped on the map side; codes come from range sizes."""
    values = df.select(F.col(quoted(column)).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    codes = numbered(values, ["value"], "code").select("value", F.col("code").cast("int").alias("code"))
    table = cut_lineage(codes)
    s = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("b")).first()
    return Dictionary(column, table, s["n"], (s["b"] or 0) + ENTRY_BYTES * s["n"])


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def coded(df: DataFrame, dictionaries, params: Params = Params()) -> DataFrame:
    """``df`` with the columns of the dictionaries turned into codes, -1 for null and unknown values.

    A dictionary within ``broadcast_bytes`` is broadcast. A longer one is joined by shuffle and repeated
    per salt bucket, so that rows of one frequent value spread; a row's bucket depends on its columns
    and its input partition, so a task that runs again takes the same ones.
    """
    names = df.columns
    for d in dictionaries:
        table = d.table.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        on = F.col(quoted(d.column)).cast("string") == F.col("__value")
        if d.n_bytes <= params.broadcast_bytes:
            joined = df.join(F.broadcast(table), on, "left")
        else:
            salts = params.salt_buckets
            row = [F.col(quoted(f.name)) for f in df.schema.fields if _hashable(f.dataType)]
            salt = F.pmod(F.xxhash64(F.spark_partition_id(), *row), F.lit(salts))
            table = table.withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            salted = df.withColumn("__salt", salt.cast("int"))
            joined = salted.join(table, on & (F.col("__salt") == F.col("__bucket")), "left")
        code = F.coalesce(F.col("__code"), F.lit(-1)).alias(d.column)
        df = joined.select(*[code if n == d.column else F.col(quoted(n)) for n in names])
    return df


def with_values(df: DataFrame, d: Dictionary, code: str, name: str) -> DataFrame:
    """``df`` with ``name``, the value that the column ``code`` stands for (null for -1)."""
    return df.join(d.table.select(F.col("code").alias(code), F.col("value").alias(name)), code, "left")
