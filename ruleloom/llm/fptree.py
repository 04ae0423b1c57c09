"""Ranked lexical search over document FP-trees.

Queries are items, a stated set that is taken in blocks of at most ITEM_BYTES of text. For a block, every document becomes
a vector of the block's terms only, with their frequencies; vectors are written once and the table's statistics (documents,
terms, document frequencies) come from them by ordinary aggregates.

A task takes the vectors it reads in trees of at most TREE_TERMS terms. Terms are put in order of document frequency,
common ones first, and documents in order of their vectors, so documents with a common beginning share a path of the trie
and a subtree is a run of documents. Every inner node above LEAF documents keeps, for each of its children, the largest
frequency of each term in the child's subtree and the smallest length figure m; small neighbouring subtrees count as one
child. For an item these give an upper bound of every child's scores: depth first, the best bound first, children are
dropped whose bound is below the k-th best score so far, large ones are opened, small ones are scored in full from lists by
term. Bounds equal to the k-th score stay, so ties are exact. The
k-th best scores are carried to the task's next tree. Lists of trees merge in two steps of row numbers, so no task gets
more than a share of one item's lists.

Trees follow the rows as they come; a text that a third of all rows share is a run of siblings in each tree. A row's
memory is its vector of block terms, whatever its length; long texts are hashed in blocks. Terms are known by 64-bit hashes.

Null texts have no terms. Documents without an item's terms are never returned, items without terms or matches give no rows.
Repeated rows and equal ids are rows of their own on both sides, null ids come first among equal scores. Extra columns are
not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.storage import written
from ruleloom.llm.text import column_bytes, ranges, word_hashes

TOP = 50
ITEM_BYTES = 8 << 20
TREE_TERMS = 2_000_000
LEAF = 256
MERGE_SALTS = 32
NULL_ID = -(2**63)
# The scale of scores, of frequencies and of m, and the shares of m that are fixed and that follow length.
SCALE, TF_SCALE, M_SCALE, M_BASE, M_LENGTH = 1_000_000_000, 1000, 20, 50, 50
#: Everything below 128 but digits and letters parts terms.
PARTING = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = column_bytes(batch.column("text"))
        for a, b in ranges(bounds):
            words, at = word_hashes(data, bounds[a : b + 1], True, PARTING)
            terms = [np.unique(words[x:y]).view(np.int64) for x, y in zip(at, at[1:])]
            yield pa.record_batch([batch.column("item_id").slice(a, b - a), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])


def _vectors(shared):
    """n of every document and its block terms, by place in the sorted vocabulary, with their frequencies."""

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            data, bounds = column_bytes(batch.column("text"))
            for a, b in ranges(bounds):
                words, at = word_hashes(data, bounds[a : b + 1], True, PARTING)
                place = np.searchsorted(vocabulary, words)
                place[place == len(vocabulary)] = 0
                known = np.flatnonzero(vocabulary[place] == words)
                text = np.searchsorted(at, known, "right") - 1
                key, tf = np.unique(text * len(vocabulary) + place[known], return_counts=True)
                starts = pa.array(np.searchsorted(key, np.arange(b - a + 1) * len(vocabulary)).astype(np.int32))
                terms = pa.array((key % len(vocabulary)).astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(at)),
                        pa.ListArray.from_arrays(starts, terms),
                        pa.ListArray.from_arrays(starts, pa.array(tf.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


class Query:
    """An item's terms as ranks, with their weights; terms of weight 0 add nothing and are left out."""

    __slots__ = ("ranks", "weights")

    def __init__(self, ranks: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(ranks)
        order = order[weights[order] > 0]
        self.ranks, self.weights = ranks[order], weights[order]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term counts before its weight. Grows with tf and falls with m, so the largest tf and the smallest m bound it."""
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (TF_SCALE * tf + M_SCALE * m)


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places from low to high, one range after the other."""
    size = high - low
    return np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


class Best:
    """The k best (score, doc_id) so far: largest score first, then smallest id."""

    def __init__(self, k: int) -> None:
        self.k, self.limit = k, 0.0
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.limit) & (scores > 0)
        if not keep.any():
            return
        scores, ids = np.r_[self.scores, scores[keep]], np.r_[self.ids, ids[keep]]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.limit = float(self.scores[-1])


class Lists:
    """By term: places (children or documents) that have it, with their impacts."""

    __slots__ = ("terms", "at", "place", "impact")

    def __init__(self, terms: np.ndarray, at: np.ndarray, place: np.ndarray, impact: np.ndarray) -> None:
        self.terms, self.at, self.place, self.impact = terms, at, place, impact

    def sums(self, query: Query, n: int) -> np.ndarray:
        """For each of n places the weighted impacts of the query's terms; whole numbers, exact in doubles."""
        found = np.searchsorted(self.terms, query.ranks)
        found[found == len(self.terms)] = 0
        met = self.terms[found] == query.ranks
        found = found[met]
        low, high = self.at[found], self.at[found + 1]
        spans = _spans(low, high)
        return np.bincount(self.place[spans], np.repeat(query.weights[met], high - low) * self.impact[spans], n)


class Node:
    """An inner node. A child is an inner node, or a run of neighbouring small subtrees that together reach LEAF at most."""

    __slots__ = ("children", "inner", "lists")


class Tree:
    """The FP-tree of documents given by ranks (ascending in each document), tfs, bounds, m and ids."""

    def __init__(self, ranks: np.ndarray, tfs: np.ndarray, at: np.ndarray, m: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        raw = ranks.astype(">u4").tobytes()
        keys = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        places = _spans(at[order], at[order + 1])
        self.at = np.r_[0, np.cumsum(np.diff(at)[order])]
        self.m, self.ids, self.leaf = m[order], ids[order], leaf
        self.nodes: list[Node] = []
        self._parted(self._shared(ranks[places]))
        self._listed(ranks[places], tfs[places])

    def _shared(self, ranks: np.ndarray) -> np.ndarray:
        """How many terms each document's path shares with that of the one before it."""
        out, at = np.zeros(len(self.ids), np.int64), self.at.tolist()
        for i in range(1, len(out)):
            n = min(at[i + 1] - at[i], at[i] - at[i - 1])
            apart = ranks[at[i] : at[i] + n] != ranks[at[i - 1] : at[i - 1] + n]
            out[i] = int(apart.argmax()) if apart.any() else n
        return out

    def _parted(self, shared: np.ndarray) -> None:
        """Nodes from the root down, and the runs of documents below them."""
        open_, runs, done = [(0, len(self.ids))], [], 0
        while done < len(open_):
            low, high = open_[done]
            inside = shared[low + 1 : high]
            starts = [low, *(low + 1 + np.flatnonzero(inside == inside.min())).tolist()] if len(inside) else [low]
            node = Node()
            node.children, node.inner, run = [], [], None
            for a, b in zip(starts, [*starts[1:], high]):
                if b - a > self.leaf:
                    node.children.append(len(open_))
                    node.inner.append(True)
                    open_.append((a, b))
                    run = None
                elif run is not None and b - runs[run][0] <= self.leaf:
                    runs[run] = (runs[run][0], b)
                else:
                    run = len(runs)
                    runs.append((a, b))
                    node.children.append(run)
                    node.inner.append(False)
            self.nodes.append(node)
            done += 1
        self.runs = runs

    def _listed(self, ranks: np.ndarray, tfs: np.ndarray) -> None:
        """The lists of runs and nodes; nodes from the last one up, since a parent needs its children's maxima."""
        size = np.diff(self.at)
        first_doc, run_of = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for r, (a, b) in enumerate(self.runs):
            first_doc[a:b], run_of[a:b] = a, r
        doc = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((doc, ranks, run_of[doc]))
        doc, ranks, tfs = doc[order], ranks[order], tfs[order]
        run, every = run_of[doc], impact(tfs, self.m[doc])
        begins = np.flatnonzero(np.r_[True, (ranks[1:] != ranks[:-1]) | (run[1:] != run[:-1])])
        ends = np.r_[begins[1:], len(ranks)]
        most, terms = np.maximum.reduceat(tfs, begins), ranks[begins]
        bound = np.searchsorted(run[begins], np.arange(len(self.runs) + 1))
        place = (doc - first_doc[doc]).astype(np.int32)
        self.lists, maxima, least = [], [], []
        for r, (a, b) in enumerate(self.runs):
            x, y = int(bound[r]), int(bound[r + 1])
            low, high = (int(begins[x]), int(ends[y - 1])) if y > x else (0, 0)
            self.lists.append(Lists(terms[x:y], np.r_[begins[x:y], high] - low, place[low:high], every[low:high]))
            maxima.append((terms[x:y], most[x:y]))
            least.append(int(self.m[a:b].min()))
        whole: dict[int, tuple] = {}
        for i in range(len(self.nodes) - 1, -1, -1):
            node = self.nodes[i]
            parts = [whole.pop(c) if inner else (*maxima[c], least[c]) for c, inner in zip(node.children, node.inner)]
            t, child = np.concatenate([p[0] for p in parts]), np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            tf, m = np.concatenate([p[1] for p in parts]), np.array([p[2] for p in parts], np.int64)
            order = np.argsort(t, kind="stable")
            t, child, tf = t[order], child[order], tf[order]
            new = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            node.lists = Lists(t[new], np.r_[new, len(t)], child.astype(np.int32), impact(tf, m[child]))
            whole[i] = t[new], np.maximum.reduceat(tf, new), int(m.min())

    def search(self, query: Query, best: Best) -> int:
        """Adds this tree's documents to ``best``; returns how many were scored."""
        stack, scored = [(math.inf, True, 0)], 0
        while stack:
            bound, inner, i = stack.pop()
            if bound < best.limit:
                continue
            if not inner:
                low, high = self.runs[i]
                best.add(self.lists[i].sums(query, high - low), self.ids[low:high])
                scored += high - low
                continue
            node = self.nodes[i]
            upper = node.lists.sums(query, len(node.children))
            # The likeliest child is opened next: it lifts the limit that its siblings are held against.
            for c in np.argsort(upper, kind="stable").tolist():
                if upper[c] >= best.limit and upper[c] > 0:
                    stack.append((float(upper[c]), node.inner[c], node.children[c]))
        return scored


HITS = "item long, salt int, score long, doc_id long"


def _searched(shared, k: int, leaf: int, tree_terms: int):
    def run(batches):
        items, rank, n_docs, n_terms, weights = shared.value
        queries = [Query(rank[t], weights[t]) for t in items]
        best = [Best(k) for _ in items]
        salt = TaskContext.get().partitionId() % MERGE_SALTS
        held, size = [], 0

        def searched():
            terms, tfs, sizes, n, ids = (np.concatenate(x) for x in zip(*held))
            at = np.r_[0, np.cumsum(sizes)]
            order = np.lexsort((rank[terms], np.repeat(np.arange(len(sizes)), sizes)))
            m = 100 - M_BASE + (M_LENGTH * n * n_docs) // n_terms
            tree = Tree(rank[terms[order]], tfs[order], at, m, ids, leaf)
            for q, b in zip(queries, best):
                if len(q.ranks):
                    tree.search(q, b)

        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            sizes = np.diff(terms.offsets.to_numpy())
            n, ids = batch.column("n").to_numpy(), batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            terms, tfs = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                before = ends[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(ends, before + tree_terms - size, "right")))
                span = slice(before, ends[stop - 1])
                held.append((terms[span], tfs[span], sizes[first:stop], n[first:stop], ids[first:stop]))
                size += span.stop - span.start
                first = stop
                if size >= tree_terms:
                    searched()
                    held, size = [], 0
        if held:
            searched()
        for i, b in enumerate(best):
            if len(b.ids):
                m = len(b.ids)
                yield pa.record_batch(
                    [pa.array([i] * m, pa.int64()), pa.array([salt] * m, pa.int32()), pa.array(b.scores.astype(np.int64)), pa.array(b.ids)],
                    names=["item", "salt", "score", "doc_id"],
                )

    return run


def _item_blocks(items: DataFrame, item_bytes: int) -> tuple[DataFrame, int]:
    """The items with a block number each, and how many blocks: none above ``item_bytes`` unless one item is."""
    sized = items.select("item_id", "text", F.octet_length("text").alias("size"))
    facts = sized.agg(F.sum("size").alias("all"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n")).first()
    blocks = -(-(facts["all"] or 0) // item_bytes) or 1
    while True:
        dealt = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        fullest = dealt.groupBy("block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).filter(F.col("size") > item_bytes).agg(F.max("n")).first()[0]
        if not fullest or fullest == 1 or blocks > 4 * facts["n"]:
            return dealt.drop("size"), blocks
        blocks *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES, tree_terms: int = TREE_TERMS, leaf: int = LEAF) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    asked, blocks = _item_blocks(asked, item_bytes)
    out = None
    for block in range(blocks):
        mine = asked.filter(F.col("block") == block).select("item_id", "text").mapInArrow(_item_terms, "item_id long, terms array<long>").collect()
        mine = [(r["item_id"], np.array(r["terms"], np.int64).view(np.uint64)) for r in mine if r["terms"]]
        if not mine:
            continue
        vocabulary = np.unique(np.concatenate([t for _, t in mine]))
        sent = spark.sparkContext.broadcast(vocabulary)
        vectors = written(rows.mapInArrow(_vectors(sent), "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors")
        facts = vectors.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not facts["docs"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * facts["docs"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        by_rank = spark.sparkContext.broadcast(([np.searchsorted(vocabulary, t) for _, t in mine], rank, facts["docs"], facts["terms"], weights))
        hits = vectors.filter(F.size("terms") > 0).mapInArrow(_searched(by_rank, k, leaf, tree_terms), HITS)
        best = [F.desc("score"), "doc_id"]
        few = hits.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).filter(F.col("place") <= k)
        top = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(i for i, _ in mine)), "item long, item_id long")
        doc_id = F.nullif(F.col("doc_id"), F.lit(NULL_ID))
        found = written(top.join(F.broadcast(names), "item").select("item_id", "rank", doc_id.alias("doc_id"), "score"), "ranked")
        sent.unpersist()
        by_rank.unpersist()
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1),
f AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM n, f),
v AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM v GROUP BY 1), f
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN v USING (term) JOIN m USING (doc_id) GROUP BY 1, 2
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op13(spark, sf_dir) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
