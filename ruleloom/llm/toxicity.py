"""Toxic passages by maximum-scoring segments, and a toxicity score for every text.

A word (a run of letters, A-Z lower-cased) scores its log-odds between toxic and clean texts under a Dirichlet prior in
proportion to the word's overall frequency; any other word costs a little. The prior rules the size of a score only. Which
words score is a likelihood ratio test on the raw counts, at a level for the number of words tested, so a word of a small
language enters as its texts gather, whatever its share of all texts.
A word's first STEM letters score alike, for words that vary at their ends; the better of both scores holds. A word counts
once for each text, and copies or near copies of a text count as one, lest their words look toxic.
Ruzzo and Tompa's linear scan then finds all maximal scoring segments of a text, and extreme-value statistics (Karlin
and Altschul) say how probable such a segment is in a clean text of that length. The surprise of all segments together
goes through a logistic calibration.

Fitting takes about FIT_ROWS labelled texts, drawn by hash of the id; the lexicon (at most LEXICON words) goes to the tasks
that score all texts in one scan. Whole texts are scanned, of any length.

Null and empty texts have no segments and get the score of such texts. Labels without value are not used; of several
labels of an id the largest holds. Without labels every score is 0. Repeated rows and null ids are scored like others. Of
copies in the fitting sample the row with the smallest id counts, so ties do not follow the order of rows. An empty table
gives an empty result. Columns other than doc_id and text (doc_id and toxic of labels) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.storage import remainder
from ruleloom.llm.text import NOT_LETTERS, column_bytes, inner_grams, mixed, ranges, stemmed_hashes, word_hashes

FIT_ROWS = 24_000
LEXICON = 50_000
#: Words of inflected languages are also known by so many first letters.
STEM = 4
PRIOR = 20_000.0
#: A word of the lexicon occurs in so many texts at least, and at most this share of the lexicon is there by chance.
LEAST_TEXTS, BY_CHANCE = 4, 0.05
LEAST_COST = 0.05
MOST_SCORE = 8.0
SIGNIFICANT = 0.01
THRESHOLD = 0.3


def segments(places: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score); places between those given cost ``cost`` each."""
    # A segment keeps its first and last place, the totals left and right of it, and the nearest earlier segment of
    # smaller left total. Searches follow that link only, so each segment is passed over once: linear time.
    found: list[tuple[int, int, float, float, int]] = []
    total, before = 0.0, None
    for place, score in zip(places, scores):
        if before is not None:
            total -= cost * (place - before - 1)
        first, low, high = place, total, total + score
        total, before = high, place
        j = len(found) - 1
        while j >= 0:
            if found[j][2] >= low:
                j = found[j][4]
            elif found[j][3] >= high:
                break
            else:
                first, _, low, _, link = found[j]
                del found[j:]
                j = link
        found.append((first, place, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _looked_up(hashes: np.ndarray, words: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The score of each word, 0 for unknown ones."""
    if not len(words):
        return np.zeros(len(hashes))
    spot = np.searchsorted(words, hashes)
    spot[spot == len(words)] = 0
    return np.where(words[spot] == hashes, scores[spot], 0.0)


def _texts(batch: pa.RecordBatch, words: np.ndarray, scores: np.ndarray, cost: float) -> Iterator[tuple[int, int, list]]:
    """Row, number of words and segments of every text."""
    data, bounds = column_bytes(batch.column("text"))
    for a, b in ranges(bounds):
        hashes, at, stems = stemmed_hashes(data, bounds[a : b + 1], True, NOT_LETTERS, STEM)
        each = np.maximum(_looked_up(hashes, words, scores), _looked_up(stems, words, scores))
        hits = np.flatnonzero(each)
        cut = np.searchsorted(hits, at)
        score = each[hits]
        for i in range(b - a):
            h = slice(cut[i], cut[i + 1])
            found = segments((hits[h] - at[i]).tolist(), score[h].tolist(), cost) if cut[i + 1] > cut[i] else []
            yield a + i, int(at[i + 1] - at[i]), found


def _marked(batches):
    """Adds two keys that copies and most near copies share: the smallest word triples by two hashes."""
    for batch in batches:
        data, bounds = column_bytes(batch.column("text"))
        keys = np.zeros((2, batch.num_rows), np.uint64)
        for a, b in ranges(bounds):
            words, at = word_hashes(data, bounds[a : b + 1], True, NOT_LETTERS)
            grams, _, text = inner_grams(words, at, 3)
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else text
            keys[:, a:b] = mixed(np.arange(a, b) + (words[0] if len(words) else np.uint64(0)))
            for k, salt in enumerate((0, 0x2545F4914F6CDD1D)):
                if len(text):
                    keys[k, a + text[first]] = np.minimum.reduceat(mixed(grams ^ np.uint64(salt)), first)
        yield pa.record_batch([*batch.columns, *[pa.array(k.view(np.int64)) for k in keys]], names=["doc_id", "text", "toxic", "key1", "key2"])


def _one_of(rows: DataFrame, key: str) -> DataFrame:
    """The row of the smallest id of each key."""
    order = F.struct("doc_id", F.xxhash64("text"), "toxic")
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def _counted(batches):
    """In how many clean and toxic texts each word or stem occurs."""
    clean, toxic = {}, {}
    for batch in batches:
        data, bounds = column_bytes(batch.column("text"))
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for a, b in ranges(bounds):
            hashes, at, stems = stemmed_hashes(data, bounds[a : b + 1], True, NOT_LETTERS, STEM)
            text = np.repeat(np.arange(b - a), np.diff(at))
            both, texts = np.r_[hashes, stems[stems > 0]], np.r_[text, text[stems > 0]]
            for y, held in ((0, clean), (1, toxic)):
                pair = np.stack([texts.astype(np.uint64), both], 1)[label[a:b][texts] == y]
                pair = pair[np.lexsort((pair[:, 0], pair[:, 1]))]
                new = np.r_[True, (pair[1:] != pair[:-1]).any(1)] if len(pair) else np.zeros(0, bool)
                values, n = np.unique(pair[new, 1], return_counts=True)
                for v, c in zip(values.tolist(), n.tolist()):
                    held[v] = held.get(v, 0) + c
    words = np.array(list(clean.keys() | toxic.keys()), np.uint64)
    columns = [pa.array(words.view(np.int64)), *[pa.array([held.get(w, 0) for w in words.tolist()], pa.int64()) for held in (clean, toxic)]]
    yield pa.record_batch(columns, names=["word", "clean", "toxic"])


def _surprise(n: np.ndarray, found: list[list[float]], rate: float, k: float) -> np.ndarray:
    """log(1 + sum over segments of -ln p)."""
    out = np.zeros(len(n))
    for i, s in enumerate(found):
        if len(s):
            expected = k * max(n[i], 1) * np.exp(-rate * np.array(s))
            out[i] = np.maximum(0, -np.log(np.maximum(-np.expm1(-expected), 1e-300))).sum()
    return np.log1p(out)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum() - 1e-2 * a, ((y - p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _evidence(n0: int, n1: int):
    """Likelihood ratio statistic (G) of ``toxic`` against ``clean`` for a word more frequent in toxic texts, 0 for others."""
    both = F.col("clean") + F.col("toxic")
    part = lambda y, total: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) * float(n0 + n1) / (both * float(total)))).otherwise(0.0)
    return F.when(F.col("toxic") * float(n0) > F.col("clean") * float(n1), 2 * (part("toxic", n1) + part("clean", n0))).otherwise(0.0)


def _significant(evidence: np.ndarray, tested: int) -> int:
    """How many of the falling values hold when BY_CHANCE of them may be chance; exp(-G / 2) bounds the binomial tail."""
    places = np.arange(1, len(evidence) + 1)
    good = np.flatnonzero(-evidence / 2 <= np.log(BY_CHANCE * places / max(tested, 1)))
    return int(good[-1]) + 1 if len(good) else 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Lexicon, extreme-value parameters and calibration from labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(4) != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    n = known.count()
    model = {"words": np.zeros(0, np.uint64), "scores": np.zeros(0), "cost": 1.0, "rate": 1.0, "k": 1.0, "a": -30.0, "b": 0.0}
    if not n:
        return model
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) / 1e6
    chosen = F.broadcast(known.filter(draw < min(1.0, fit_rows / n)))
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    single = _one_of(_one_of(sample.mapInArrow(_marked, "doc_id long, text binary, toxic int, key1 long, key2 long"), "key1"), "key2")
    counts = single.select("text", "toxic").mapInArrow(_counted, "word long, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.persist()
    n0, n1 = (x or 0 for x in counts.agg(F.sum("clean"), F.sum("toxic")).first())
    if n0 and n1:
        alpha = PRIOR * (F.col("clean") + F.col("toxic")) / float(n0 + n1)
        odds = lambda y, total: F.log((F.col(y) + alpha) / (total + PRIOR - F.col(y) - alpha))
        delta = odds("toxic", n1) - odds("clean", n0)
        often = counts.filter(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
        tested = often.select("word", "clean", "toxic", delta.alias("delta"), _evidence(n0, n1).alias("evidence"))
        found = tested.filter((F.col("evidence") > 0) & (F.col("delta") > 0)).orderBy(F.desc("evidence"), "word").limit(LEXICON).collect()
        found = found[: _significant(np.array([r.evidence for r in found]), often.count())]
        words, score = np.array([r.word for r in found], np.int64).view(np.uint64), np.array([min(r.delta, MOST_SCORE) for r in found])
        order = np.argsort(words)
        c0, c1 = np.array([r.clean for r in found], float), np.array([r.toxic for r in found], float)
        rest0, rest1 = n0 - c0.sum(), n1 - c1.sum()
        cost = max(LEAST_COST, -float(np.log((rest1 + 1) / n1) - np.log((rest0 + 1) / n0)))
        p0 = (c0 + 0.5) / (n0 + 0.5 * len(c0) + 1)
        low, high = 1e-3, 20.0
        for _ in range(80):
            rate = (low + high) / 2
            low, high = (rate, high) if (p0 * np.exp(rate * score)).sum() + (1 - p0.sum()) * np.exp(-rate * cost) < 1 else (low, rate)
        model |= {"words": words[order], "scores": score[order], "cost": cost, "rate": low}
    counts.unpersist()
    rows = sample.mapInArrow(_segment_rows(docs.sparkSession.sparkContext.broadcast(model)), "n long, toxic int, scores array<double>").collect()
    size, y = np.array([r.n for r in rows], float), np.array([r.toxic for r in rows], float)
    if not len(rows):
        return model
    clean = [(r.n, max(r.scores, default=0.0)) for r in rows if not r.toxic and r.n]
    if clean:
        length, best = np.array(clean, float).T
        model["k"] = float(np.clip(np.exp(np.mean(model["rate"] * best - np.log(length)) - np.euler_gamma), 1e-9, 1e3))
    model["a"], model["b"] = _logistic(_surprise(size, [r.scores for r in rows], model["rate"], model["k"]), y)
    return model


def _segment_rows(shared):
    def run(batches):
        m = shared.value
        for batch in batches:
            found = list(_texts(batch, m["words"], m["scores"], m["cost"]))
            columns = [pa.array([n for _, n, _ in found], pa.int64()), batch.column("toxic"), pa.array([[s for *_, s in f] for *_, f in found], pa.list_(pa.float64()))]
            yield pa.record_batch(columns, names=["n", "toxic", "scores"])

    return run


def passages(docs: DataFrame, model: dict, significant: float = SIGNIFICANT) -> DataFrame:
    """doc_id, first_word, last_word, score, p_value of every significant passage; words are counted from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for i, n, found in _texts(batch, m["words"], m["scores"], m["cost"]):
                for a, b, s in found:
                    p = float(-np.expm1(-m["k"] * n * np.exp(-m["rate"] * s)))
                    if p <= significant:
                        out.append((ids[i], a, b, s, p))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["doc_id", "first_word", "last_word", "score", "p_value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, first_word long, last_word long, score double, p_value double")


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and n_passages of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            found = list(_texts(batch, m["words"], m["scores"], m["cost"]))
            n, values = np.array([n for _, n, _ in found], float), [[s for *_, s in f] for *_, f in found]
            x = _surprise(n, values, m["rate"], m["k"])
            p = 1 / (1 + np.exp(-np.clip(m["a"] + m["b"] * x, -30, 30)))
            many = [sum(-np.expm1(-m["k"] * k * np.exp(-m["rate"] * s)) <= SIGNIFICANT for s in v) for k, v in zip(n, values)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array(many, pa.int64())], names=["doc_id", "score", "n_passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_passages long")


def op9(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
