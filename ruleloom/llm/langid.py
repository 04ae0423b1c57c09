"""Language of a text by its nearest centroid.

A text is its byte 1- to 3-grams, A-Z lower-cased and other ASCII that is no letter turned to blanks, hashed to ``DIM``
places, square-rooted, weighed by inverse document frequency and brought to length 1. Every language has several
centroids, found by spherical k-means; the nearest by cosine names the language, and the cosine is the score. A centroid of
few texts is no part of its language but of texts labelled or quoted wrongly, so it goes.
A text further away than the reach of its language is marked as rejected, as is one without a letter. Short texts lie further
off, so reaches are fitted by length: from cosines of texts to centroids of the other half of their language's texts.

Fitting takes about ``FIT_DOCS`` texts of each language, drawn by hash of the id, and is the only step on a sample. Its
centroids (at most MOST_LANGUAGES * CENTROIDS * DIM floats) are sent to the tasks that score all texts in one scan.

Null texts and texts without letter are ``und`` with score 0. A table without labels makes every text ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm.storage import remainder
from ruleloom.llm.text import LOWER, NOT_LETTERS, column_bytes

DIM = 4096
CENTROIDS = 4
FIT_DOCS = 600
MOST_LANGUAGES = 500
ROUNDS = 12
#: Centroids with less than this share of their language's texts go.
LEAST_SHARE = 0.02
#: Bounds of the lengths in bytes with reaches of their own, and the step from one to the next shorter without texts.
LENGTHS, SHORTER = np.array([64, 256, 1024]), 0.6
#: A text is rejected below this share, by length, of the cosine that all but one in a hundred fitting texts of its length
#: reach. Short texts have few n-grams and vary more.
REACH = np.array([0.6, 0.6, 0.7, 0.7])
FOLD = np.where(NOT_LETTERS, np.uint8(32), LOWER)
SLICE = 1 << 21


def _counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, a row per text; a long text is counted slice by slice."""
    n = len(bounds) - 1
    out = np.zeros((n, DIM), np.float32)
    first, last = int(bounds[0]), int(bounds[-1])
    for start in range(first, last, SLICE):
        end = min(last, start + SLICE)
        b = FOLD[data[start : min(last, end + 2)]].astype(np.int32)
        text = np.searchsorted(bounds, np.arange(start, start + len(b)), "right") - 1
        own = end - start
        for size in (1, 2, 3):
            m = min(own, len(b) - size + 1)
            if m <= 0:
                continue
            if size == 1:
                place = b[:m]
            elif size == 2:
                place = 256 + (b[:m] * 257 + b[1 : m + 1]) * 40503 % 65521 % 1280
            else:
                place = 1536 + (b[:m] * 7919 + b[1 : m + 1] * 263 + b[2 : m + 2]) * 613 % 1000003 % 2560
            good = (text[:m] == text[size - 1 : m + size - 1]) & (b[:m] + b[size - 1 : m + size - 1] != 64)
            t0, t1 = int(text[0]), int(text[-1]) + 1
            flat = (text[:m][good] - t0) * DIM + place[good]
            out[t0:t1] += np.bincount(flat, minlength=(t1 - t0) * DIM).reshape(-1, DIM)
    return out


def vectors(data: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(_counts(data, bounds)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def chunks(bounds: np.ndarray, most: int = 256, size: int = SLICE):
    """Index ranges of texts, few enough and together short enough (or one alone)."""
    k = 0
    while k < len(bounds) - 1:
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + size, "right")) - 1)
        end = min(end, k + most)
        yield k, end
        k = end


def _presence(batches):
    total = np.zeros(DIM, np.int64)
    for batch in batches:
        data, bounds = column_bytes(batch.column("text"))
        for a, b in chunks(bounds):
            total += (_counts(data, bounds[a : b + 1]) > 0).sum(0)
    yield pa.record_batch([pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total)], names=["place", "n"])


def _cluster(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart seeds: centres and each text's cosine to its own."""
    centres = [v.mean(0)]
    while len(centres) < min(k, len(v)):
        centres.append(v[np.argmin((v @ np.array(centres).T).max(1))])
    c = np.array(centres)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = (v @ c.T).argmax(1)
        c = np.array([v[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, (v @ c.T).max(1)


def _centroids(v: np.ndarray, k: int) -> np.ndarray:
    """Centres with a good share of the texts; texts of small clusters are set aside and the others clustered anew."""
    rest = v
    for _ in range(ROUNDS):
        c, _ = _cluster(rest, k)
        near = (rest @ c.T).argmax(1)
        small = np.bincount(near, minlength=len(c)) < LEAST_SHARE * len(v)
        if not small.any() or small.all():
            break
        rest = rest[~small[near]]
    return c[~small] if not small.all() else c


def _unseen(v: np.ndarray, k: int) -> np.ndarray:
    """Each text's cosine to centroids of the texts of the other half."""
    out = np.zeros(len(v))
    for half in (0, 1):
        if len(v) > 1:
            out[1 - half :: 2] = (v[1 - half :: 2] @ _centroids(v[half::2], k).T).max(1)
    return out


def _reaches(cosines: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """A row of reaches by length for each language: the lower one of its own texts and of all texts."""

    def low(cosine, size):
        length = np.searchsorted(LENGTHS, size, "right")
        return np.array([np.quantile(cosine[length == j], 0.01) if (length == j).any() else np.nan for j in range(len(LENGTHS) + 1)])

    found = np.fmin(low(np.concatenate(cosines), np.concatenate(sizes)), [low(c, s) for c, s in zip(cosines, sizes)])
    for row in found:
        some = np.flatnonzero(~np.isnan(row))
        for j in np.flatnonzero(np.isnan(row)):
            row[j] = row[some[some < j][-1]] if j > some[0] else row[some[0]] * SHORTER ** (some[0] - j)
    return REACH * found


def fit(rows: DataFrame, fit_docs: int = FIT_DOCS, centroids: int = CENTROIDS) -> dict:
    """Centroids from ``rows`` (doc_id, text, lang)."""
    lettered = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    empty = {"languages": [], "centres": np.zeros((0, DIM), np.float32), "reach": np.zeros((0, len(LENGTHS) + 1)), "idf": np.ones(DIM, np.float32)}
    if not sizes:
        return empty
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs / n))]), F.col("lang"))
    sample = lettered.filter(draw < share).filter(F.col("text").rlike(r"\p{L}")).select("lang", F.col("text").cast("binary").alias("text"))
    seen = sample.select("text").mapInArrow(_presence, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    present = np.zeros(DIM)
    for r in seen:
        present[r.place] = r.n
    idf = (np.log((1 + sum(min(n, fit_docs) for n in sizes.values())) / (1 + present)).clip(0) + 1).astype(np.float32)

    def centre(table: pa.Table) -> pa.Table:
        data, bounds = column_bytes(table.column("text"))
        v = np.concatenate([vectors(data, bounds[a : b + 1], idf) for a, b in chunks(bounds)])
        c, cosine = _centroids(v, centroids), _unseen(v, centroids)
        columns = [[table.column("lang")[0].as_py()], [c.ravel().tolist()], [cosine.tolist()], [np.diff(bounds).tolist()]]
        kinds = [pa.string(), pa.list_(pa.float32()), pa.list_(pa.float64()), pa.list_(pa.int64())]
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["lang", "centres", "cosines", "sizes"])

    found = sample.groupBy("lang").applyInArrow(centre, "lang string, centres array<float>, cosines array<double>, sizes array<long>").collect()
    if not found:
        return empty
    found.sort(key=lambda r: r.lang)
    reach = _reaches([np.array(r.cosines) for r in found], [np.array(r.sizes) for r in found])
    each = [np.array(r.centres, np.float32).reshape(-1, DIM) for r in found]
    many = [len(c) for c in each]
    languages = [r.lang for r, n in zip(found, many) for _ in range(n)]
    return {"languages": languages, "centres": np.concatenate(each), "reach": np.repeat(reach, many, axis=0), "idf": idf}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and rejected put beside its columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def name(batches):
        m = shared.value
        for batch in batches:
            data, bounds = column_bytes(batch.column("text"))
            n = batch.num_rows
            best, cosine = np.zeros(n, np.int64), np.zeros(n)
            if m["languages"]:
                for a, b in chunks(bounds):
                    near = vectors(data, bounds[a : b + 1], m["idf"]) @ m["centres"].T
                    best[a:b], cosine[a:b] = near.argmax(1), near.max(1)
            known = batch.column("letter").to_numpy(zero_copy_only=False) & bool(m["languages"])
            cosine = np.where(known, np.clip(cosine, 0, 1), 0.0)
            lang = [m["languages"][j] if k else "und" for j, k in zip(best, known)]
            far = ~known
            if m["languages"]:
                far |= cosine < m["reach"][best, np.searchsorted(LENGTHS, np.diff(bounds), "right")]
            yield pa.record_batch(
                [batch.column("row"), pa.array(lang, pa.string()), pa.array(cosine), pa.array(far)], names=["row", "lang_pred", "score", "rejected"]
            )

    kinds = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return rows.mapInArrow(name, T.StructType([rows.schema["row"], *[T.StructField(c, t) for c, t in kinds]]))


def fitted(docs: DataFrame, **kw) -> dict:
    """A model from the rows that are not held out."""
    return fit(docs.filter(remainder(3) != 1).select("doc_id", "text", "lang"), **kw)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, as they are."""
    return predict(docs, fitted(docs)).filter(~F.col("rejected")).select("row.*")


def op2(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), fitted(docs))
    return found.select("row.doc_id", (remainder(3, "row.doc_id") == 1).alias("held_out"), "lang_pred", "score")
