import hashlib
import math
from collections import Counter

import pytest

from plain_text import corpus, frame, words
from ruleloom.llm import mixing

SOURCES = ["b", "a", None, "Z", "é", "a ", ""]


def goals(sizes):
    """Targets by pouring: give shares, stop full sources, pour the excess on."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, over, now = sum(weight[s] for s in open_), 0.0, list(open_)
        for s in now:
            target[s] += left * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                over += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
        left = over
    return target


def plain(rows):
    sizes = Counter()
    for d, t, _, s in rows:
        sizes[s] += len(words(t))
    target, out = goals(sizes), []
    for s in sizes:
        docs = []
        for d, t, _, src in rows:
            if src == s:
                n, u = len(words(t)), (int(hashlib.md5(f"mix-1:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                off = (len(t or "") / max(n, 1) - 6) / 4
                docs.append((-math.log(u) * (1 + off * off), -1 if d is None else d, n))
        epochs = int(target[s] // max(sizes[s], 1))
        left = math.floor(target[s] + 0.5) - epochs * sizes[s]
        for _, d, n in sorted(docs):
            part = max(0, min(n, left))
            left -= part
            out.append((d, n, sizes[s], round(target[s], 3), epochs * n + part))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain(spark, seed):
    rows = [(d, t, "en", SOURCES[min(d % 23, len(SOURCES) - 1) if d % 3 else 0]) for d, t in corpus(500, seed)] + [(None, "no id", "en", "b"), (3, "x y", "en", "b"), (3, "x y", "en", "b")]
    found = mixing.mix(frame(spark, rows, 4, size=1, key="x", target=2)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in found) == plain(rows)
    by = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert all(abs(sum(v) - target) <= len(by) for (_, target), v in by.items())


def test_odd_tables(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    found = mixing.mix(frame(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2


def test_rows_follow_the_mix(spark):
    rows = [(d, t, "en", "ab"[d % 4 == 0]) for d, t in corpus(300, 3)]
    docs = frame(spark, rows, 4, taken="kept", size=9)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    count = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.mix(docs).collect():
        assert abs(count[r.doc_id] * r.size - r.taken) <= r.size / 2


def test_plan_is_native(spark):
    plan = mixing.mixed_rows(frame(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
