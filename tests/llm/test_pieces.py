import random

import numpy as np
import pytest

from plain_text import corpus, frame
from ruleloom.llm.pieces import BYTE_WEIGHT, Pieces, Viterbi, decode, encode, pieces, round_trips

ODD = ["", " ", "  a  b ", "▁", "x▁y ▁", "\n\t\x0b a\n\nb", "日本語 テキスト😀", "é é z q", "a" * 3000, "thethethe" * 500, " " * 700, "zero\x00nul", "a;\r\n {\r\n \r x\u00a0y\u3000z \r"]


def ids_of(p, text):
    return np.frombuffer(p.encode(text), "<u4").tolist()


def best(p, text):
    """Weight of the best segmentation by the plain recurrence over the whole text."""
    s = " " + text
    w = [0.0] + [None] * len(s)
    for e in range(1, len(s) + 1):
        options = [w[b] + p.table[s[b:e]][0] for b in range(max(0, e - p.longest), e) if s[b:e] in p.table]
        if s[e - 1 : e] not in p.table:
            options.append(w[e - 1] + BYTE_WEIGHT * len(s[e - 1].encode()))
        w[e] = max(options)
    return w[-1]


def weight(p, ids):
    by_id = {i: w for w, (i,) in p.table.values()}
    return sum(by_id.get(i, BYTE_WEIGHT) for i in ids)


def test_best_and_reversible():
    p, r = Pieces(), random.Random(1)
    texts = ODD + [t or "" for _, t in corpus(60, 3)] + ["".join(r.choice("ab the éñ\n.,ingtion") for _ in range(r.randint(1, 400))) for _ in range(60)]
    for t in texts:
        ids = ids_of(p, t)
        assert p.decode(ids).decode() == t
        if t:
            assert abs(weight(p, ids) - best(p, t)) < 1e-6 * max(1, len(t))


def test_streaming_equals_whole_text_and_keeps_a_small_window():
    p = Pieces()
    assert p.by_words
    for t in [x for x in ODD if x] + ["the internationalization of things " * 300]:
        v = Viterbi(p)
        whole = list(v.run(" " + t))
        assert abs(weight(p, whole) - weight(p, ids_of(p, t))) < 1e-6 * len(t)
        assert v.widest <= 6 * p.longest or len(set(t)) <= 3


def test_remembered_words_are_bounded(monkeypatch):
    import ruleloom.llm.pieces as module

    monkeypatch.setattr(module, "REMEMBERED", 10)
    p = Pieces()
    text = " ".join("w%d" % i for i in range(200))
    assert p.decode(ids_of(p, text)).decode() == text and len(p.words) <= 10


def test_tables(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (3, "twice"), (3, "twice")]
    docs = frame(spark, rows, 3, ids=1, n_ids="x")
    found = round_trips(docs).collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    back = decode(encode(docs)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((d or -1, t or "") for d, t in rows)
    assert round_trips(frame(spark, [])).collect() == []
    assert [r.ids for r in encode(frame(spark, [(1, None)])).collect()] == [[]]


def test_one_lookup_for_each_beginning():
    """The recurrence asks one dictionary: all beginnings of pieces, with weight and ids where they are pieces."""
    p = Pieces()
    assert {k: v for k, v in p.heads.items() if v is not None} == p.table
    assert set(p.heads) == {x[:n] for x in p.table for n in range(1, len(x) + 1)}
    for text in [*ODD, "ab cd" * 200, "née ☃ " * 90]:
        if text:
            assert abs(weight(p, list(Viterbi(p).run(" " + text))) - best(p, text)) < 1e-6 * max(1, len(text))


def test_words_with_marks_are_put_together(monkeypatch):
    """A word beside marks is searched for once, whatever marks stand there, and has the ids of a search over all of it."""
    import ruleloom.llm.pieces as module

    p, searched = Pieces(), []
    run = Viterbi.run
    monkeypatch.setattr(module.Viterbi, "run", lambda self, text: searched.append(text) or run(self, text))
    text = "anblewh anblewh, anblewh. anblewh; (anblewh) \"anblewh\" anblewh&&& anblewh?! anblewh&&&"
    found = ids_of(p, text)
    assert searched.count(" anblewh") == 1 and not {" anblewh,", " anblewh.", " anblewh;", " anblewh?!"} & set(searched)
    assert " anblewh&&&" in searched
    r = random.Random(7)
    for _ in range(400):
        word = " " + "".join(r.choice("theanbé&%*$,.'\"(1\r—☃") for _ in range(r.randint(1, 30)))
        whole = [i for w in p.split.findall(word) for i in run(Viterbi(p), w)]
        assert ids_of(p, word[1:]) == whole
    assert p.decode(found).decode() == text
