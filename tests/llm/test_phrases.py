import hashlib
from collections import Counter

import numpy as np
import pytest

from plain_text import corpus, frame, words
from ruleloom.llm.phrases import without_repeats
from ruleloom.llm.text import SAME, column_bytes, word_hashes


def plain(rows, window):
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed, window, phrase, most", [(1, 35, 8, 20000), (2, 35, 8, 3), (3, 12, 5, 7)])
def test_equals_plain(spark, seed, window, phrase, most):
    rows = corpus(300, seed)
    found = without_repeats(frame(spark, rows, 4, part=1, records="x"), window, phrase, part_bytes=3000, automaton_phrases=most)
    assert sorted(map(tuple, found.collect())) == plain(rows, window)


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "a " * 100), (4, "a b " * 20), (4, "a b " * 20), (5, " ".join("x%d" % i for i in range(70000))), (6, "y " + " ".join("x%d" % i for i in range(500, 540)))]
    assert sorted(map(tuple, without_repeats(frame(spark, rows)).collect())) == plain(rows, 35)
    assert without_repeats(frame(spark, [])).collect() == []


def test_word_hashes_cut_long_texts_between_words():
    import pyarrow as pa

    import ruleloom.llm.text as text

    raw = [b"aB c\td  " * 50, None, b"", b"x" * 2000 + b" y", b" z", "é à".encode()]
    data, bounds = column_bytes(pa.array(raw, pa.binary()))
    whole = word_hashes(data, bounds, lower=False)
    size, text.BLOCK_BYTES = text.BLOCK_BYTES, 37
    try:
        cut = word_hashes(data, bounds, lower=False)
    finally:
        text.BLOCK_BYTES = size
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert np.diff(whole[1]).tolist() == [len((r or b"").split()) for r in raw]
    lower = word_hashes(*column_bytes(pa.array([b"ab AB Ab"], pa.binary())))[0]
    assert len(set(lower.tolist())) == 1 and SAME[7] == 7
