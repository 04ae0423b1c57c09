import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plain_text import frame
from ruleloom.llm import toxicity
from ruleloom.llm.storage import remainder
from ruleloom.llm.text import NOT_LETTERS, column_bytes, word_hashes

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("fit_rows, languages", [(1_500, ["de", "en", "fr"]), (24_000, ["de", "en", "es", "fr"])])
def test_recall_of_each_language(spark, fit_rows, languages):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kinds = {r.doc_id: (r.lang, r.toxic) for r in docs.join(known, "doc_id").filter(remainder(4) == 2).select("doc_id", "lang", "toxic").collect()}
    model = toxicity.fit(docs, labels, fit_rows)
    found = [(*kinds[r.doc_id], r.score >= toxicity.THRESHOLD) for r in toxicity.scored(docs, model).collect() if r.doc_id in kinds]
    for language in languages:
        assert np.mean([p for lang, y, p in found if lang == language and y]) > 0.8
    assert np.mean([p for _, y, p in found if not y]) < 0.03


def test_evidence_grows_with_texts_at_equal_shares(spark):
    """A word in toxic texts alone scores once there are enough of them, however small its share of all texts."""
    vile = word_hashes(*column_bytes(pa.array([b"vile"])), True, NOT_LETTERS)[0][0]
    r, found = random.Random(3), {}
    for times in (1, 8):
        spelt = lambda: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(40))
        rows = [(i, spelt() if i < 300 * times else f"vile {spelt()}") for i in range(302 * times)]
        labels = spark.createDataFrame([(d, int(d >= 300 * times), 0) for d, _ in rows], "doc_id long, toxic int, quality int")
        found[times] = vile in toxicity.fit(frame(spark, rows), labels)["words"]
    assert found == {1: False, 8: True}
