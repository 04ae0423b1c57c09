import numpy as np
import pytest

from ruleloom.llm import langid
from ruleloom.llm.storage import remainder

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("language, least", [("en", 0.85), ("es", 0.95), ("fr", 0.95), ("de", 0.95)])
def test_a_language_withheld_from_fitting_goes(spark, language, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", (remainder(3) == 1).alias("held_out"))
    model = langid.fitted(docs.filter(f"lang <> '{language}'"))
    rows = langid.predict(docs, model).select("row.lang", "row.held_out", "rejected").collect()
    assert np.mean([r.rejected for r in rows if r.lang == language]) > least
    assert np.mean([r.rejected for r in rows if r.held_out and r.lang != language]) < 0.004


def test_reaches_of_lengths_without_texts():
    cosine, size = np.full(10, 0.5), np.full(10, 300)
    other = np.full(10, 0.4)
    assert np.allclose(langid._reaches([cosine, other], [size, size]) / langid.REACH, np.array([[0.4 * 0.36, 0.4 * 0.6, 0.4, 0.4]] * 2))
