"""Exact dedup with radix-trie owners.

Texts are equal when their bytes are identical after lower-casing A-Z. Each task first folds the copies it sees, so a
text that a third of all rows share arrives once per task. Length and content hash deal the texts out to partitions; the
texts of a partition go, in byte order, into one compressed radix trie of full byte strings, whose terminal nodes hold the
owner. Shared beginnings are stored once, and the bytes alone decide what is equal: hashes only say where a text goes.

Because texts come in order, all but the path of the latest one is final, and such subtrees are handed on and freed
whenever the trie outgrows its bound. Memory is one bounded trie and two texts, whatever the number of copies.

Null text counts as empty. Of equal texts the largest doc_id owns (a null id is smallest). Rows repeated with id and
text alike share one kept row. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLD_BYTES = 16 << 20
TRIE_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(column: str = "text"):
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, LOWER), 256)


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 64:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low + len(os.path.commonprefix([a[low:high], b[low:high]]))


class RadixTrie:
    """Byte strings with their owner: the largest id, and the number of copies. A node is [label, children, owner]."""

    def __init__(self) -> None:
        self.root, self.bytes, self.last = [b"", {}, None], 0, b""

    def insert(self, key: bytes, doc_id: int | None, copies: int) -> None:
        node, at = self.root, 0
        self.last = key
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                self.bytes += len(key) - at + 200
                node, at = child, len(key)
                break
            label = child[0]
            same = common(label, key[at : at + len(label)])
            if same < len(label):
                upper = node[1][key[at]] = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
                self.bytes += 200
                child = upper
            node, at = child, at + same
        node[2] = (_larger(node[2][0], doc_id), node[2][1] + copies) if node[2] else (doc_id, copies)

    def take(self, all_of_it: bool = True) -> Iterator[tuple[bytes, int | None, int]]:
        """The terminals, which leave the trie; unless all, those on the path of the latest key stay."""
        keep = set()
        if not all_of_it:
            node, at = self.root, 0
            keep.add(id(node))
            while at < len(self.last):
                node = node[1][self.last[at]]
                at += len(node[0])
                keep.add(id(node))
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            path = above + node[0]
            stack += [(child, path) for child in node[1].values()]
            if id(node) not in keep:
                if node[2]:
                    yield path, *node[2]
            else:
                node[1] = {k: c for k, c in node[1].items() if id(c) in keep}
        if all_of_it:
            self.root, self.bytes = [b"", {}, None], 0
        else:
            self.bytes = len(self.last) + 200


FOLDED = "n_bytes long, content_hash long, text binary, doc_id long, copies long"
OWNERS = "text_sha256 string, keep_id long, group_size long"


def _fold(batches):
    """The distinct normalised texts of a task with largest id and copies, handed on whenever they outgrow a bound."""
    held, size = {}, 0

    def rows():
        keys = list(held)
        return pa.record_batch(
            [
                pa.array([len(k) for k in keys], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(k) - 2**63 for k in keys], pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([v[0] for v in held.values()], pa.int64()),
                pa.array([v[1] for v in held.values()], pa.int64()),
            ],
            names=["n_bytes", "content_hash", "text", "doc_id", "copies"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            key = (text.as_py() or b"").lower()
            found = held.get(key)
            if found is None:
                held[key] = (doc_id, 1)
                size += len(key) + 100
                if size > FOLD_BYTES:
                    yield rows()
                    held, size = {}, 0
            else:
                held[key] = (_larger(found[0], doc_id), found[1] + 1)
    if held:
        yield rows()


def _own(batches):
    """Owners of the texts of a partition, from (text, doc_id, copies) in byte order of the texts."""

    trie = RadixTrie()

    def taken(all_of_it):
        done = []
        for text, owner, n in trie.take(all_of_it):
            done.append((hashlib.sha256(text).hexdigest(), owner, n))
            if len(done) >= 10_000:
                yield _owner_rows(done)
                done = []
        if done:
            yield _owner_rows(done)

    for batch in batches:
        texts, ids, copies = (batch.column(i) for i in range(3))
        for text, doc_id, n in zip(texts, ids.to_pylist(), copies.to_pylist()):
            text = text.as_py()
            if trie.bytes > TRIE_BYTES and text != trie.last:
                yield from taken(False)
            trie.insert(text, doc_id, n)
    yield from taken(True)


def _owner_rows(found):
    return pa.record_batch(
        [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
        names=["text_sha256", "keep_id", "group_size"],
    )


def owners(docs: DataFrame) -> DataFrame:
    """text_sha256, keep_id, group_size of every distinct normalised text."""
    folded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_fold, FOLDED)
    placed = folded.repartition("n_bytes", "content_hash").select("text", "doc_id", "copies")
    return placed.sortWithinPartitions("text").mapInArrow(_own, OWNERS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("text_sha256"))
    counted = rows.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    found = counted.join(owners(docs), "text_sha256")
    one = found.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("turn"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return one.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns as they are."""
    found = owners(docs)
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_digest().alias("sha"))
    keep = found.select(F.col("text_sha256").alias("sha"), F.col("keep_id").alias("id"))
    stay = row.join(keep, (row.sha == keep.sha) & row.id.eqNullSafe(keep.id), "left_semi")
    return stay.dropDuplicates(["sha", "id"]).select("row.*")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
    row_number() OVER (PARTITION BY doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS turn
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, (d.doc_id IS NOT DISTINCT FROM g.keep_id AND turn = 1) AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


def op7(spark, sf_dir) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
