import itertools

import numpy as np
import pytest

from plain_text import corpus, frame, lowered, words
from ruleloom.llm.jaccard import Rule, near_components, one_of_each


def plain(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        w = words(lowered(text))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed, shard", [(1, 4096), (2, 3), (3, 1)])
def test_components_equal_all_pairs(spark, seed, shard):
    rows = corpus(400, seed)
    found = near_components(frame(spark, rows, 5, doc_id_2=1, n=3, token="x"), shard=shard, bucket_bytes=2000)
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_tasks_are_cut_by_bytes(spark):
    rows = corpus(300, 4)
    for set_bytes in (800, 20_000):
        assert sorted(map(tuple, near_components(frame(spark, rows), set_bytes=set_bytes).collect())) == plain(rows)


def test_one_row_stays_of_a_component_with_equal_ids(spark):
    base = " ".join("w%d" % i for i in range(80))
    rows = [(1, base), (2, base + " x"), (2, "quite another text of a few words"), (1, base + " y"), (3, base + " z"), (None, base + " q"), (4, ""), (4, None)]
    kept = sorted(((r.doc_id or 0, r.text) for r in one_of_each(frame(spark, rows)).collect()), key=str)
    assert [k for k in kept if k[1] and k[1].startswith("w0")] in ([(1, base)], [(1, base + " y")])
    assert (2, rows[2][1]) in kept and (4, "") in kept and (4, None) in kept and len(kept) == 4


def test_large_family_and_common_passage(spark):
    base = ["v%d" % i for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[(7 * i) % 120] = "e%d" % i
        if i % 3 == 0:
            w[(11 * i + 60) % 120] = "f%d" % i
        rows.append((i, " ".join(w)))
    shared = " ".join("p%d" % i for i in range(50))
    rows += [(1000 + i, shared + " " + " ".join("u%d_%d" % (i, k) for k in range(40))) for i in range(200)]
    assert sorted(map(tuple, near_components(frame(spark, rows), shard=16).collect())) == plain(rows)


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "A\tB"), (5, "x " * 30000), (6, "X " * 29999), (7, " ")]
    assert sorted(map(tuple, near_components(frame(spark, rows)).collect())) == plain(rows)
    assert near_components(frame(spark, [])).collect() == []
    kept = one_of_each(frame(spark, rows, extra=5))
    assert kept.columns[-1] == "extra" and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 3, 5, 7]


def test_prefixes_hold_all_links():
    rule = Rule(85)
    for a in range(1, 200):
        for b in range(a, 240):
            for o in range(1, a + 1):
                if rule.linked(o, a, b):
                    need = int(rule.slack(np.int64(a)))
                    assert o >= need and a - o + need <= rule.query_prefix(a) <= a and b - o + need <= rule.member_prefix(b) <= b
                    break
