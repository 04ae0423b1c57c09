"""Connected components by alternating stars, with joins and aggregates only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.storage import written

MOST_ROUNDS = 60


def _stars(batches):
    """The edges of a batch with every node hung on the smallest that it reaches there."""
    for batch in batches:
        root: dict[int, int] = {}

        def top(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        hung = [(x, top(x)) for x in list(root) if root[x] != x]
        yield pa.record_batch([pa.array([x for x, _ in hung], pa.int64()), pa.array([y for _, y in hung], pa.int64())], names=["a", "b"])


def _settled(now: DataFrame) -> bool:
    """Whether every node has one edge, to a root."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("hung"), F.lit(0).alias("root"))
    ends = ends.union(now.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("hung").alias("hung"), F.max("root").alias("root"))
    return ends.filter("hung > 1 or hung > 0 and root > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) of all nodes of the edges ``a``, ``b``.

    Edges that come together are made stars first. Then each round hangs the larger neighbours of a node, and its smaller
    ones, on the smallest of them (Kiveris et al., 2014), until every edge leads to a root. Rounds are written, so that the
    few edges of one are the few tasks of the next.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    now = written(written(edges, "edges").mapInArrow(_stars, "a long, b long"), "stars")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            break
        both = now.union(now.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a")
        small = small.select("b", "low").union(low.select("a", "low")).toDF("a", "b").filter("a <> b").distinct()
        now = written(small, "stars")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
