import numpy as np
import pytest

from plain_text import frame, held
from ruleloom.llm import langid, toxicity

SF = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = langid.op2(spark, SF).collect()
    assert len(found) == len(lang) and all(r.held_out == (held(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in found)
    out = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.99
    assert langid.accepted(docs).count() > 0.999 * len(lang)


def test_language_odd_rows(spark):
    rows = [(i, f"the of and this {i} that is here", "en", "s") for i in range(9)] + [(i + 9, f"der die und das {i} nicht ist", "de", "s") for i in range(9)]
    docs = frame(spark, rows + [(90, None, None, "s"), (91, "12 !? 3", None, "s"), (92, "", None, "s"), (93, "the and of " * 90000, None, "s")], row="x", letter=1, score="y")
    model = langid.fit(docs)
    found = {r["row"].doc_id: r for r in langid.predict(docs, model).collect()}
    assert [found[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and all(found[i].rejected and found[i].score == 0 for i in (90, 91, 92))
    assert found[93].lang_pred == "en" and all(found[d].lang_pred == lang for d, _, lang, _ in rows)
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and 90 not in {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.filter("lang is null"))).collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).collect() == [] and langid.fit(frame(spark, []))["languages"] == []


def test_far_texts_are_rejected(spark):
    rows = [(i, f"the of and this {i} that is here with some words of it", "en", "s") for i in range(40)]
    docs = frame(spark, rows + [(100, "жызф щцчш юяэъ ыьйё " * 20, None, "s")])
    assert [r["row"].doc_id for r in langid.predict(docs, langid.fit(docs)).collect() if r.rejected] == [100]


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    found = [r for r in toxicity.op9(spark, SF).collect() if r.doc_id in labels and r.held_out]
    assert all(held(r.doc_id, 4) == 2 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    y, p = np.array([labels[r.doc_id] for r in found]), np.array([r.predicted for r in found])
    assert 2 * (y & p).sum() / (y.sum() + p.sum()) > 0.9


def test_toxicity_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "vile " * 5), (3, "vile " * 5)], toxic=1, score="x")
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    found = toxicity.scored(docs, toxicity.fit(docs, empty)).collect()
    assert [round(r.score, 9) for r in found] == [0.0] * 4
    model = {"words": np.array(sorted(_hash("vile")), np.uint64), "scores": np.array([5.0]), "cost": 0.1, "rate": 1.0, "k": 0.1, "a": -3.0, "b": 2.0}
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert scores[3] > 0.9 and scores[1] == scores[2] < 0.1
    assert {(r.doc_id, r.first_word, r.last_word) for r in toxicity.passages(docs, model).collect()} == {(3, 0, 4)}
    assert toxicity.scored(frame(spark, []), model).collect() == []
    one = toxicity.fit(docs, spark.createDataFrame([(3, 1, 1), (None, 1, 1), (2, None, 0)], "doc_id long, toxic int, quality int"))
    assert np.isfinite(one["a"])


def _hash(word):
    import pyarrow as pa

    from ruleloom.llm.text import NOT_LETTERS, column_bytes, word_hashes

    return word_hashes(*column_bytes(pa.array([word.encode()])), True, NOT_LETTERS)[0].tolist()


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_the_maximal_ones(seed):
    r = np.random.default_rng(seed)
    places = np.flatnonzero(r.random(40) < 0.4)
    scores = r.integers(1, 6, len(places)).astype(float)
    full = np.full(40, -1.0)
    full[places] = scores
    sums = np.r_[0, np.cumsum(full)]

    def split(a, b):
        """Best segment of a range, then left and right of it, by all pairs."""
        best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return [*split(a, i), (i, j - 1, best[0]), *split(j, b)]

    assert toxicity.segments(places.tolist(), scores.tolist(), 1.0) == split(0, 40)


def test_segment_scan_is_linear():
    """Single hits that fall are the usual case in clean texts: earlier segments must not be walked again and again."""

    class Counted(float):
        steps = 0

        def __ge__(self, other):
            Counted.steps += 1
            return float(self) >= float(other)

        def __add__(self, other):
            return Counted(float(self) + float(other))

        __radd__ = __add__

        def __sub__(self, other):
            return Counted(float(self) - float(other))

    n = 16_000
    for scores in ([Counted(1.0)] * n, [Counted(1.0 + k % 7) for k in range(n)]):
        Counted.steps = 0
        found = toxicity.segments(list(range(0, 9 * n, 9)), scores, Counted(1.0))
        assert sum(s for *_, s in found) > 0 and Counted.steps <= 6 * n


def test_stems_are_letters():
    import pyarrow as pa

    from ruleloom.llm.text import NOT_LETTERS, column_bytes, stemmed_hashes

    stems = lambda *w: stemmed_hashes(*column_bytes(pa.array([x.encode() for x in w])), True, NOT_LETTERS, 4)[2].tolist()
    a, b, c, short = stems("дурачок", "дурак", "дубина", "дур")
    assert a == b != c and short == 0 and a != 0
    one, two, plain = stems("été", "étés", "vileness")
    assert one == 0 and two != 0 and plain == stems("vile")[0]
