import math
import re
from collections import Counter

import numpy as np
import pytest

from plain_text import corpus, frame, lowered
from ruleloom.llm.fptree import Best, Query, Tree, _item_blocks, impact, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    rows = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in rows:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = 0
            for t in set(TERM.findall(lowered(text))):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def asked(spark, items, **extra):
    df = spark.createDataFrame(items, "item_id long, text string")
    return df.selectExpr("*", *[f"'{v}' AS {c}" for c, v in extra.items()])


@pytest.mark.parametrize("seed, k, leaf, tree_terms, item_bytes", [(1, 50, 256, 2_000_000, 8 << 20), (2, 5, 4, 300, 8 << 20), (3, 1, 1, 50, 4000)])
def test_equals_all_scores(spark, seed, k, leaf, tree_terms, item_bytes):
    docs = corpus(300, seed, vocabulary=120)
    items = [(i, t) for i, t in corpus(30, seed + 50, vocabulary=150)] + [(99, "unseen words only"), (3, "w1-w2 W3_w4 É w1")]
    found = ranked(frame(spark, docs, 4, terms=1, n="x"), asked(spark, items, rank="r", score="s"), k, item_bytes, tree_terms, leaf)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, items, k)


def test_copies_and_ties(spark):
    docs = [(i, "same words here") for i in range(400)] + [(1000 + i, "other words") for i in range(5)] + [(7, "same words here"), (None, "same words here")]
    items = [(1, "words same"), (1, "words same"), (None, "other")]
    found = ranked(frame(spark, docs, 6), asked(spark, items), 50, leaf=16)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, items, 50)


def test_odd_tables(spark):
    docs = [(1, None), (2, ""), (3, "  \n-"), (4, "a" * 400_000 + " b"), (5, "a b " * 50_000), (6, "b"), (6, "b")]
    items = [(1, None), (2, ""), (3, "b"), (4, "--"), (5, "A b")]
    found = ranked(frame(spark, docs), asked(spark, items))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, items, 50)
    assert ranked(frame(spark, []), asked(spark, items)).collect() == []
    assert ranked(frame(spark, docs), asked(spark, [])).collect() == []
    assert ranked(frame(spark, docs[:3]), asked(spark, items)).collect() == []


def test_item_blocks_are_bounded(spark):
    items = asked(spark, [(i, "x" * (i % 50)) for i in range(200)])
    dealt, blocks = _item_blocks(items, 500)
    sizes = [r.s for r in dealt.selectExpr("block", "length(text) AS s").groupBy("block").sum("s").toDF("block", "s").collect()]
    assert blocks > 9 and max(sizes) <= 500 and sum(sizes) == sum(i % 50 for i in range(200)) and dealt.count() == 200


@pytest.mark.parametrize("leaf", [1, 8, 64])
def test_bounds_hold_and_prune(leaf):
    r = np.random.default_rng(leaf)
    vectors = [np.unique(r.zipf(1.4, r.integers(1, 40)) % 300) for _ in range(1500)]
    sizes = np.array([len(v) for v in vectors])
    ranks, at = np.concatenate(vectors), np.r_[0, np.cumsum(sizes)]
    tfs, m, ids = r.integers(1, 9, len(ranks)), r.integers(50, 400, len(sizes)), r.permutation(len(sizes))
    tree = Tree(ranks, tfs, at, m, ids, leaf)
    assert sum(b - a for a, b in tree.runs) == len(ids) and sorted(tree.ids.tolist()) == list(range(len(ids)))
    every = impact(tfs, np.repeat(m, sizes))
    scored = 0
    for _ in range(40):
        terms = np.unique(r.integers(0, 300, 12))
        weights = r.integers(0, 5000, len(terms))
        q = Query(terms, weights)
        full = np.zeros(300, np.int64)
        full[terms] = weights
        score = np.add.reduceat(full[ranks] * every, at[:-1])
        best = Best(10)
        scored += tree.search(q, best)
        order = [i for i in np.lexsort((ids, -score)) if score[i] > 0][:10]
        assert best.ids.tolist() == ids[order].tolist() and best.scores.tolist() == score[order].tolist()
    assert leaf > 8 or scored < 40 * len(ids) * 0.8
