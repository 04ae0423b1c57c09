import hashlib
import random

import pytest

from plain_text import corpus, frame, lowered
from ruleloom.llm import exact


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lowered(t), []).append(-1 if d is None else d)
    out = []
    for t, ids in groups.items():
        seen = set()
        for d in ids:
            kept = d == max(ids) and d not in seen
            seen.add(d)
            out.append((d, max(ids), len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


ROWS = corpus(300, 6) + [(400, "Same"), (401, "sAME"), (402, "ÉTÉ"), (403, "été"), (404, None), (5, "twice"), (5, "twice"), (None, "same"), (None, "alone")] + [(1000 + i, "Hot text") for i in range(300)]


@pytest.mark.parametrize("fold, trie", [(1 << 20, 1 << 20), (200, 300)])
def test_equals_plain(spark, monkeypatch, fold, trie):
    monkeypatch.setattr(exact, "FOLD_BYTES", fold)
    monkeypatch.setattr(exact, "TRIE_BYTES", trie)
    found = exact.exact_dedup(frame(spark, ROWS, 5, text_sha256="x", copies=2)).collect()
    n = lambda x: -1 if x is None else x
    assert sorted((n(r.doc_id), n(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in found) == plain(ROWS)
    assert exact.exact_dedup(frame(spark, [])).collect() == []


def test_rows_that_stay(spark):
    docs = frame(spark, ROWS, 5, row="x", sha=1)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    n = lambda x: -1 if x is None else x
    assert sorted(n(r.doc_id) for r in kept.collect()) == sorted(d for d, _, _, k, _ in plain(ROWS) if k)


@pytest.mark.parametrize("seed", range(4))
def test_trie_holds_byte_strings(seed):
    r = random.Random(seed)
    keys = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) + b"x" * r.choice([0, 0, 300]) for _ in range(200))
    want, got, trie = {}, {}, exact.RadixTrie()
    for i, k in enumerate(keys):
        d = r.choice([None, i])
        old = want.get(k, (None, 0))
        want[k] = (exact._larger(old[0], d), old[1] + 1)
        if r.random() < 0.2 and trie.last != k:
            for key, owner, n in trie.take(False):
                assert key not in got
                got[key] = (owner, n)
        trie.insert(k, d, 1)
    for key, owner, n in trie.take():
        got[key] = (owner, got[key][1] + n) if key in got else (owner, n)
    assert got == want and trie.bytes == 0


def batch(rows):
    import pyarrow as pa

    kinds = (pa.binary(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["text", "doc_id", "copies"])


def test_bytes_decide():
    (found,) = exact._own([batch([(b"aaaa", 1, 1), (b"aaab", 2, 1), (b"aaab", 7, 2), (b"zzzz", 3, 1)])])
    assert sorted(zip(found.column(1).to_pylist(), found.column(2).to_pylist())) == [(1, 1), (3, 1), (7, 3)]


@pytest.mark.parametrize("bound", [0, 5_000, 1 << 20])
def test_one_trie_holds_many_texts_of_a_partition(monkeypatch, bound):
    """Shared beginnings are stored once; finished subtrees leave when the trie outgrows its bound."""
    monkeypatch.setattr(exact, "TRIE_BYTES", bound)
    most, kept = [0], exact.RadixTrie.insert

    def insert(self, key, doc_id, copies):
        kept(self, key, doc_id, copies)
        n, stack = 0, [self.root]
        while stack:
            node = stack.pop()
            n, stack = n + bool(node[2]), stack + list(node[1].values())
        most[0] = max(most[0], n)

    monkeypatch.setattr(exact.RadixTrie, "insert", insert)
    rows = sorted((b"shared beginning " * 20 + bytes([97 + i // 10]) * (i % 5) + str(i % 90).encode(), i, 1) for i in range(100))
    out = [r for b in exact._own([batch(rows[:41]), batch(rows[41:])]) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = {}
    for text, i, n in rows:
        sha = hashlib.sha256(text).hexdigest()
        old = want.get(sha, (-1, 0))
        want[sha] = (max(old[0], i), old[1] + n)
    assert {sha: (i, n) for sha, i, n in out} == want and len(out) == len(want)
    assert most[0] == len(want) if bound > 5_000 else 1 <= most[0] < len(want)


def test_trie_stores_shared_beginnings_once():
    trie = exact.RadixTrie()
    for i in range(100):
        trie.insert(b"x" * 10_000 + bytes([i]), i, 1)
    assert trie.bytes < 60_000
