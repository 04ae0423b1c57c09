import hashlib
import random

import numpy as np
import pytest

from plain_text import frame
from ruleloom.llm.fim import ARRANGED, PieceTable, byte_of, code_points, fill_in_middle, inverse, restore, restored


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = t[:lo], t[lo:hi], t[hi:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", lo, hi - lo, f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", lo, hi - lo, f"<P>{a}<S>{c}<M>{b}"


def texts(count, seed=5):
    r = random.Random(seed)
    letters = ["a", "é", "中", "😀", " ", "\n", "<", "P", "S", ">", "<S", "M>"]
    return [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))) for i in range(count)]


def check(spark, rows, **kw):
    made = fill_in_middle(frame(spark, rows, **kw))
    found = sorted(map(tuple, made.drop("output_sha256").collect()), key=repr)
    assert found == sorted((plain(*r) for r in rows), key=repr)
    assert all(r.output_sha256 == sha(r.output) for r in made.collect())
    back = sorted(((r.doc_id, r.text, r.restored_sha256) for r in restore(made).collect()), key=repr)
    assert back == sorted(((d, t or "", sha(t or "")) for d, t in rows), key=repr)


def test_equals_slices_of_text(spark):
    check(spark, texts(600))
    forms = {r.form for r in fill_in_middle(frame(spark, texts(600))).select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "x"), (3, "x"), (3, "y"), (7, "<P> in it"), (8, "<<P"), (9, "<M"), (10, "é" * 3_000_001), (-4, "\x00a\x00")]
    check(spark, rows, output="clash", n=1, form="z", __output="w")
    assert fill_in_middle(frame(spark, [])).collect() == [] and restore(fill_in_middle(frame(spark, []))).collect() == []


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_sentinels_cut_in_texts_do_not_mislead(form):
    parts = ["<P", ">", "<", "", "S>", "<S", "<M", "M>"]
    for a in parts:
        for b in parts:
            for c in parts:
                if any(s in a + b + c for s in ("<P>", "<S>", "<M>")):
                    continue
                out = f"<P>{a}<S>{c}<M>{b}" if form == "psm" else f"<S>{c}<P>{a}<M>{b}"
                assert restored(out.encode(), form).bytes().decode() == a + b + c


def test_permutations_and_places():
    for order in ARRANGED.values():
        assert [order[i] for i in inverse(order)] == list(range(6))
    table = PieceTable((memoryview(b"abcdef"),), [(0, 0, 6)])
    table.cut(0, 2)
    table.cut(1, 0)
    assert table.pieces == [(0, 0, 2), (0, 2, 0), (0, 2, 4)] and table.permuted((2, 1, 0)).bytes() == b"cdefab"
    data = np.frombuffer(("a中" * 700_000).encode(), np.uint8)
    assert code_points(data) == 1_400_000 and [byte_of(data, k) for k in (0, 1, 2, 1_399_999, 1_400_000)] == [0, 1, 4, 2_799_997, 2_800_000]
