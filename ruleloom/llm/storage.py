"""Tables written to the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It lives as long as that folder is kept."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there: lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def part_count(docs: DataFrame, part_bytes: int, column: str = "text") -> int:
    """How many parts hold about ``part_bytes`` of text each; two per core at least."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // part_bytes))


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id``, ``text`` as bytes and ``part``: rows dealt out in turn, whatever they hold."""
    turn = F.pmod(F.monotonically_increasing_id() + F.shiftrightunsigned(F.monotonically_increasing_id(), 33) * 7, F.lit(parts))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), turn.cast("int").alias("part"))


def remainder(by: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(by))
