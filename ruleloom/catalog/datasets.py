"""Learning tables made from the given tables, in Spark and in SQL.

The SQL form yields ``row_id, x0 … xn, cls``: features as DOUBLE or VARCHAR and
the class index, -1 when a row has no class.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.session import write_out


@dataclass(frozen=True)
class Dataset:
    name: str
    features: tuple[str, ...]
    kinds: tuple[str, ...]
    classes: tuple[str, ...]
    table: Callable[[SparkSession, str], DataFrame]
    sql: str
    row_id: str | None = "row_id"
    label: str = "y"

    @property
    def numeric(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k == "numeric"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("value").alias("f0"),
        F.hour("ts").alias("f1"),
        F.get_json_object("props", "$.k").cast("int").alias("f2"),
        F.when(F.col("event_type") == "error", "error").otherwise("other").alias("y"),
    )


def labelled_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    marks = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("y"))
    return docs.join(marks, "doc_id").select(F.col("doc_id").alias("row_id"), "n_chars", "lang", "source", "y")


def all_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "n_chars", "lang", "source"
    )


def orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderpriority", F.col("o_orderstatus").alias("y")
    )


def customers(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        "o_totalprice",
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderstatus").alias("y"),
    )


def lineitem(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_linestatus",
        F.when(F.col("l_returnflag") == "R", "R").otherwise("rest").alias("y"),
    )


def embeddings(dims):
    def table(spark, sf_dir):
        e = read(spark, sf_dir, "embeddings")
        return e.select(
            F.col("vec_id").alias("row_id"),
            *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(dims)],
            F.col("label").cast("string").alias("y"),
        )

    return table


def order_lines(spark, sf_dir):
    """Lines with the total of their order, joined once: profile, learning and scoring read the written rows."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "R").otherwise("rest").alias("y"),
    )
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return write_out(
        joined.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "l_linenumber", "y"), "order-lines"
    )


def line_numbers(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_quantity", F.when(F.col("l_returnflag") == "R", "R").otherwise("rest").alias("y")
    )


def events_with_bad_numbers(spark, sf_dir):
    """The events with f0 as text: unreadable in one hour, no number in another, infinite in a third."""
    bad = F.when(F.col("f1") == 3, "n/a").when(F.col("f1") == 4, "NaN").when(F.col("f1") == 5, "-Infinity")
    return events(spark, sf_dir).withColumn("f0", bad.otherwise(F.col("f0").cast("string")))


EVENTS = Dataset(
    "events",
    ("f0", "f1", "f2"),
    ("numeric",) * 3,
    ("error", "other"),
    events,
    """SELECT event_id AS row_id, CAST(value AS DOUBLE) AS x0, CAST(hour(ts) AS DOUBLE) AS x1,
       CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS x2,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS cls FROM events""",
)
DOCUMENTS = Dataset(
    "documents",
    ("n_chars", "lang", "source"),
    ("numeric", "nominal", "nominal"),
    ("1", "0"),
    labelled_documents,
    """SELECT d.doc_id AS row_id, CAST(d.n_chars AS DOUBLE) AS x0, d.lang AS x1, d.source AS x2,
       CASE WHEN l.toxic = 1 THEN 0 WHEN l.toxic = 0 THEN 1 ELSE -1 END AS cls
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
ORDERS = Dataset(
    "orders",
    ("o_totalprice", "o_orderpriority"),
    ("numeric", "nominal"),
    ("F", "O", "P"),
    orders,
    """SELECT o_orderkey AS row_id, o_totalprice AS x0, o_orderpriority AS x1,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS cls FROM orders""",
)
CUSTOMERS = Dataset(
    "customers",
    ("o_totalprice", "customer"),
    ("numeric", "nominal"),
    ("F", "O", "P"),
    customers,
    """SELECT o_orderkey AS row_id, o_totalprice AS x0, CAST(o_custkey AS VARCHAR) AS x1,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS cls FROM orders""",
)
ORDER_LINES = Dataset(
    "order_lines",
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "l_linenumber"),
    ("numeric",) * 6,
    ("R", "rest"),
    order_lines,
    """SELECT NULL AS row_id, l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3, o_totalprice AS x4,
       CAST(l_linenumber AS DOUBLE) AS x5, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS cls
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    row_id=None,
)
LINE_NUMBERS = Dataset(
    "line_numbers",
    ("l_linenumber", "l_quantity"),
    ("nominal", "numeric"),
    ("R", "rest"),
    line_numbers,
    """SELECT NULL AS row_id, CAST(l_linenumber AS DOUBLE) AS x0, l_quantity AS x1,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS cls FROM lineitem""",
    row_id=None,
)
LINEITEM = Dataset(
    "lineitem",
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"),
    ("numeric",) * 4 + ("nominal",),
    ("R", "rest"),
    lineitem,
    """SELECT NULL AS row_id, l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3,
       l_linestatus AS x4, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS cls FROM lineitem""",
    row_id=None,
)


HOURS = Dataset(
    "hours",
    ("f1",),
    ("numeric",),
    ("error", "other"),
    events,
    """SELECT event_id AS row_id, CAST(hour(ts) AS DOUBLE) AS x0, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS cls FROM events""",
)


def embedding_set(dims: int) -> Dataset:
    xs = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(dims))
    return Dataset(
        f"embeddings_{dims}",
        tuple(f"e{i}" for i in range(dims)),
        ("numeric",) * dims,
        tuple(str(k) for k in range(10)),
        embeddings(dims),
        f"SELECT vec_id AS row_id, {xs}, CAST(label AS INTEGER) AS cls FROM embeddings",
    )


EMBEDDINGS_8 = embedding_set(8)
EMBEDDINGS_64 = embedding_set(64)
