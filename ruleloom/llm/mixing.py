"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame functions only.

Sources weigh ``shares`` in turn, by code point with null last, and share ``total`` times all words. A target stops at
``cap`` times its source's size; the excess goes to the others by weight, which is one water level over all sources.

A source is first taken whole as often as its target holds it. The rest comes from its documents in the order of
exponential keys -ln(u) / quality (Efraimidis and Spirakis: the smallest keys are a weighted sample), prefix-summed to
the words that are left; the document on the boundary gives the words that still fit. u is drawn from the md5 of seed
and id, so reruns and retries agree.

A source may hold a third of all rows. Keys are therefore binned on a log scale and only bins are summed per source;
bins before the boundary are taken, bins after it are not, and just the boundary bin is put in order row by row.

Null text has no words and null sources are a source. Quality is 1 for a mean word length of 6 letters and falls off on
both sides. Ties of keys go by id, then size. Repeated rows count each. A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SHARES, TOTAL, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
BROADCAST_SOURCES = 100_000
BIN_ROWS = 2_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def quality(size: Column, chars: Column) -> Column:
    """Weight of a document by its mean word length."""
    off = (chars / F.greatest(size, F.lit(1)) - 6.0) / 4.0
    return 1.0 / (1.0 + off * off)


def key(doc_id: Column, weight: Column, seed: str) -> Column:
    """Exponential key of rate ``weight``."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    return -F.log(u) / weight


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and key of every document."""
    size = docs.select(
        F.col("doc_id"),
        F.col("source"),
        word_count().alias("size"),
        F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
    )
    return size.select("doc_id", "source", "size", key(F.col("doc_id"), quality(F.col("size"), F.col("chars")), seed).alias("key"))


def targets(sizes: DataFrame, shares=SHARES, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size, n_rows, target: one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (place % len(shares) + 1).cast("int"))
    full = per.withColumn("share", share).withColumn("most", cap * F.col("source_size"))
    by_ratio = W.orderBy(F.col("most") / F.col("share"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("share").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    every = W.partitionBy()
    level = (total * F.sum("source_size").over(every) - before) / after
    levels = full.select("*", level.alias("level"))
    level = F.max(F.when(F.col("level") <= F.col("most") / F.col("share"), F.col("level"))).over(every)
    return levels.select("source", "source_size", "n_rows", F.coalesce(F.least("most", level * F.col("share")), F.col("most")).alias("target"))


def cuts(sizes: DataFrame, **kw) -> tuple[DataFrame, int]:
    """Per source: whole epochs, words left, and the bin of keys where they end; and the number of bins."""
    goal = cut_lineage(targets(sizes, **kw))
    most = goal.agg(F.max("n_rows").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    bins = max(1024, 20 * ((most.n or 0) // BIN_ROWS))
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(F.col("target") / size)
    goal = goal.select("*", epochs.alias("epochs"), (F.floor(F.col("target") + 0.5) - epochs * F.col("source_size")).alias("left"))
    per_bin = sizes.groupBy("source", bin_of(F.col("key"), bins).alias("bin")).agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bin"))
    per_bin = per_bin.select("source", "bin", (running - F.col("words")).alias("before"), running.alias("until"))
    goal = goal.alias("g")
    where = F.col("g.source").eqNullSafe(F.col("b.source")) & (F.col("b.before") <= F.col("g.left")) & (F.col("g.left") < F.col("b.until"))
    found = goal.join(per_bin.alias("b"), where, "left").select("g.*", "b.bin", "b.before")
    found = cut_lineage(found)
    return (F.broadcast(found) if most.sources <= BROADCAST_SOURCES else found), bins


def bin_of(k: Column, bins: int) -> Column:
    """The key's bin on a log scale; later keys never have earlier bins."""
    return F.floor((F.greatest(F.lit(-40.0), F.least(F.lit(10.0), F.log(k))) + 40.0) / 50.0 * bins).cast("int")


def taken(rows: DataFrame, cut: DataFrame, bins: int) -> DataFrame:
    """``rows`` (doc_id, source, size, key and more) with source_size, target, epochs and taken.

    ``cut`` lacks a bin where all the source's words fit; then nothing is left over either.
    """
    cut = cut.select(*[F.col(c).alias("cut_" + c) for c in cut.columns])
    rows = rows.withColumn("row_bin", bin_of(F.col("key"), bins))
    both = rows.join(cut, rows.source.eqNullSafe(cut.cut_source))
    keep = [c for c in rows.columns if c != "row_bin"]
    out = lambda fraction: [
        *keep,
        F.col("cut_source_size").alias("source_size"),
        F.col("cut_target").alias("target"),
        F.col("cut_epochs").alias("epochs"),
        (F.col("cut_epochs") * F.col("size") + fraction).cast("long").alias("taken"),
    ]
    edge = F.coalesce(F.col("row_bin") == F.col("cut_bin"), F.lit(False))
    whole = F.when(F.col("row_bin") < F.col("cut_bin"), F.col("size")).otherwise(F.lit(0))
    order = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("cut_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_left") - before))
    return both.filter(~edge).select(*out(whole)).unionByName(both.filter(edge).select(*out(part)))


def mix(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes = cut_lineage(sized(docs, seed))
    return taken(sizes, *cuts(sizes, **kw)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """The rows of ``docs`` repeated as the mix takes them; a document taken in part stays if half of it is taken."""
    cut, bins = cuts(cut_lineage(sized(docs, seed)), **kw)
    row = docs.select("doc_id", "source", word_count().alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.struct("*").alias("row"))
    row = row.select("doc_id", "source", "size", key(F.col("doc_id"), quality(F.col("size"), F.col("chars")), seed).alias("key"), "row")
    chosen = taken(row, cut, bins)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    times = F.col("epochs") + F.when((part > 0) & (2 * part >= F.col("size")), 1).otherwise(0)
    return chosen.filter(times > 0).select("row", F.explode(F.sequence(F.lit(1), times.cast("int")))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(length(text), 0) AS chars,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), keyed AS (
  SELECT doc_id, source, size, (chars::DOUBLE / greatest(size, 1)::DOUBLE - 6.0::DOUBLE) / 4.0::DOUBLE AS off, u FROM sized
), ordered AS (
  SELECT doc_id, source, size, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + off * off)) AS k FROM keyed
), per AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS share
  FROM ordered GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(share) OVER (ORDER BY 2 * source_size / share, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per
), goal AS (
  SELECT source, source_size, coalesce(least(2 * source_size, share * max(CASE WHEN level <= 2 * source_size / share THEN level END) OVER ()), 2 * source_size) AS target
  FROM levels
), cut AS (
  SELECT *, floor(target / greatest(source_size, 1)) AS epochs, floor(target + 0.5) - floor(target / greatest(source_size, 1)) * source_size AS rest FROM goal
), run AS (
  SELECT o.*, c.source_size, c.target, c.epochs, c.rest,
    coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY k, doc_id, o.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ordered o JOIN cut c ON o.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 3) AS target,
  (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM run
"""


def op1(spark, sf_dir) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("target", F.round("target", 3))
