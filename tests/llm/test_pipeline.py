import random
from collections import Counter

import corpus_pipeline
from plain_text import corpus, frame, words
from test_exact import plain as exact_plain
from test_jaccard import plain as near_plain
from test_mixing import plain as mix_plain

WORDS = {"en": "the of and to in is that it for was with as on this by".split(), "de": "der die und das ist nicht mit von ein auf sich den für zu im".split()}


def documents(n=220):
    r = random.Random(4)
    out = []
    for i, t in corpus(n, 8):
        lang = "en" if i % 3 else "de"
        mark = " ".join(r.choice(WORDS[lang]) for _ in range(12))
        out.append((i, t if i % 7 == 0 else f"{t or ''} {mark}", lang if i % 5 else None, ["a", "b", None][i % 3]))
    return out + [(900, None, "en", "a"), (901, "123 !?", "en", "b"), (902, "", None, None)]


def test_each_stage_on_its_own_input(spark, tmp_path):
    rows = documents()
    frame(spark, rows, 3, extra=7, row="x").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact dedup", "near dedup", "mixture", "token ids"]
    for k, (name, stage) in enumerate(stages.items()):
        before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        after = stage(spark, docs, str(tmp_path))
        if name != "token ids":
            assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = docs.collect()
        ids = Counter(r.doc_id for r in now)
        if name == "language":
            letterless = {d for d, t, *_ in before if not any(c.isalpha() for c in t or "")}
            assert {900, 901, 902} <= letterless and not letterless & set(ids) and len(now) >= 0.9 * (len(before) - len(letterless))
        elif name == "exact dedup":
            assert sorted(ids) == [d for d, _, _, k, _ in exact_plain([r[:2] for r in before]) if k] and max(ids.values()) == 1
        elif name == "near dedup":
            assert sorted(ids) == sorted(d for d, _, c in near_plain([r[:2] for r in before], 5, 80) if d == c)
        elif name == "mixture":
            for d, size, _, _, taken in mix_plain(before):
                assert abs(ids[d] * size - taken) <= size / 2
        else:
            assert all(r.round_trip and len(r.ids) == r.n_ids for r in now) and len(now) == len(before)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, now))


def test_words_survive():
    assert words("a\x0bb") == ["a", "b"]
