"""Texts linked by the Jaccard similarity of their word shingles: an exact join through a token-group matrix.

Texts with equal shingle sets are one class; only classes are compared. The tokens of a class are its shingle hashes in
one global order, common ones last. If two classes link, the first ``slack`` tokens that they share lie in a short
prefix of both, so:

1. prefix tokens meet by token, and a class goes on only if enough of its prefix occurs in other classes;
2. similar classes form groups: a class joins the group of its most widespread shared prefix token;
3. the matrix holds, for each token, the groups whose union of prefixes has it; a query class counts its prefix tokens
   in each group's union, without those that only itself brings in, and this count bounds its overlap with any member;
4. a group is opened by the queries whose bound reaches ``slack``; there the whole sets decide, pairs already connected
   are passed over, and a spanning forest of links comes out;
5. alternating stars turn links into components.

The query of a pair is its smaller class. No candidate is dropped: a group is split into shards and its visitors into
chunks by number of classes (SHARD) and by bytes of their token sets (SET_BYTES), and every chunk meets every shard, so a
task holds about 2 * SET_BYTES of sets at most, or two sets that are longer. Hashes have 58 bits.

The order comes from a table of SLOTS counters over all documents' shingles (fixed size, sent to all tasks). Any order
gives the same result; this one keeps passages that many documents share out of the prefixes.

A text with fewer words than a shingle is one shingle; null or empty texts link with nothing. Repeated rows and equal
ids are rows like others; null ids give a null component_id if no row of their component has an id. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.graph import components
from ruleloom.llm.packing import PACKED, flushed, packed, regrouped, unpacked
from ruleloom.llm.storage import part_count, written
from ruleloom.llm.text import column_bytes, gram_hashes, inner_grams, mixed, word_hashes
from ruleloom.session import cut_lineage

SLOTS = 1 << 20
RANGES = 256
SHARD = 4096
BUCKET_BYTES = 16 << 20
BROADCAST_CLASSES = 1_000_000
FIRST_TRIES = 8
#: Token sets of one side of a task.
SET_BYTES = 32 << 20
#: Hits of a bucket that wait for being counted.
HIT_BYTES = 16 << 20

TOKEN = np.dtype([("token", "<u8"), ("class", "<i8")])
SHARED = np.dtype([("class", "<i8"), ("token", "<u8"), ("k", "<i8")])
MATRIX = np.dtype([("token", "<u8"), ("class", "<i8"), ("group", "<i8"), ("need", "<i4"), ("role", "<i4")])
HIT = np.dtype([("class", "<i8"), ("group", "<i8"), ("need", "<i4"), ("hits", "<i4")])
MEMBER, QUERY, FIRST = 1, 2, 4


class Rule:
    """Similarity of ``percent`` or more, in whole numbers."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def linked(self, overlap, a, b):
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def slack(self, n):
        """Shared tokens that two prefixes must have."""
        return 1 + 7 * n // 100

    def query_prefix(self, n):
        """Prefix of the smaller of two classes."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + self.slack(n)

    def member_prefix(self, n):
        """Prefix of the larger one, which holds that of the smaller one."""
        return n - -(-self.percent * n // 100) + self.slack(n)

    def least(self, n):
        """Size of the smallest class that can link to one of size n."""
        return -(-self.percent * n // 100)


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (58-bit hashes) of all texts, text by text, and where each text's begin."""
    grams, _, text = inner_grams(words, at, n)
    few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < n))
    short = [gram_hashes(words[at[t] : at[t + 1]], int(at[t + 1] - at[t])) for t in few]
    grams, text = np.concatenate([grams, *short]) >> np.uint64(6), np.r_[text, few].astype(np.int64)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])] if len(grams) else np.zeros(0, bool)
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(at)))


def _segment_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)]
    return total[at[1:]] - total[at[:-1]]


def signatures(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever its order."""
    return _segment_sums(mixed(grams), at).view(np.int64), _segment_sums(mixed(grams ^ np.uint64(0x5DEECE66D)), at).view(np.int64)


def _pieces(batch: pa.RecordBatch, n: int, most: int = 1 << 21):
    """Row range, shingles and bounds of pieces of a batch."""
    data, bounds = column_bytes(batch.column("text"))
    k = 0
    while k < len(bounds) - 1:
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + most, "right")) - 1)
        yield k, end, *shingles(*word_hashes(data, bounds[k : end + 1]), n)
        k = end


def _sketch(n: int):
    """Rows of size and signature for each text, and counters of shingle slots at the end of the task."""

    def run(batches):
        counts, none = np.zeros(SLOTS, np.uint32), pa.nulls
        for batch in batches:
            for a, b, grams, at in _pieces(batch, n):
                counts += np.bincount(grams & np.uint64(SLOTS - 1), minlength=SLOTS).astype(np.uint32)
                s1, s2 = signatures(grams, at)
                m = b - a
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, m), batch.column("h").slice(a, m), pa.array(np.diff(at)), pa.array(s1), pa.array(s2), none(m, pa.int32()), none(m, pa.binary())],
                    names=["doc_id", "h", "n", "s1", "s2", "range", "counts"],
                )
        blobs = [x.tobytes() for x in counts.reshape(RANGES, -1)]
        longs = [none(RANGES, pa.int64())] * 5
        yield pa.record_batch([*longs, pa.array(np.arange(RANGES, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["doc_id", "h", "n", "s1", "s2", "range", "counts"])

    return run


def _summed(batches):
    total = {}
    for batch in batches:
        for r, blob in zip(batch.column("range").to_pylist(), batch.column("counts")):
            total[r] = total.get(r, 0) + np.frombuffer(blob.as_py(), np.uint32).astype(np.uint64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["range", "counts"])


def levels(sketch: DataFrame) -> np.ndarray:
    """How far above the mean each slot is, in half powers of two; SLOTS bytes."""
    rows = sketch.filter(F.col("range").isNotNull()).select("range", "counts").repartition("range").mapInArrow(_summed, "range int, counts binary").collect()
    counts = np.zeros((RANGES, SLOTS // RANGES))
    for r in rows:
        counts[r["range"]] += np.frombuffer(r["counts"], np.uint64)
    counts = counts.ravel()
    return np.clip(2 * np.log2(np.maximum(counts, 1) / max(counts.mean(), 1)), 0, 63).astype(np.uint8)


def _ordered(grams: np.ndarray, at: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Tokens: level above, hash below; sorted within each text."""
    tokens = (level[(grams & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | grams
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return tokens[np.lexsort((tokens, text))]


def _token_rows(docs: DataFrame, n: int, level, whole: bool, rule: Rule) -> DataFrame:
    """n, s1, s2, q_last and the tokens (all, or the member prefix) of every text that has any."""

    def run(batches):
        for batch in batches:
            for _, _, grams, at in _pieces(batch, n):
                tokens, sizes = _ordered(grams, at, level.value), np.diff(at)
                s1, s2 = signatures(grams, at)
                some = np.flatnonzero(sizes)
                m = sizes[some]
                stop = m if whole else rule.member_prefix(m)
                raw = tokens.tobytes()
                blobs = [raw[8 * a : 8 * (a + c)] for a, c in zip(at[:-1][some].tolist(), stop.tolist())]
                q_last = tokens[at[:-1][some] + rule.query_prefix(m) - 1].view(np.int64)
                yield pa.record_batch(
                    [pa.array(m), pa.array(s1[some]), pa.array(s2[some]), pa.array(q_last), pa.array(blobs, pa.binary())], names=["n", "s1", "s2", "q_last", "tokens"]
                )

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "n long, s1 long, s2 long, q_last long, tokens binary")


def _explode_tokens(buckets: int):
    def pieces(batches):
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column("tokens").to_pylist()], np.int64)
            records = np.zeros(int(sizes.sum()), TOKEN)
            records["token"] = unpacked(batch.column("tokens"), "<u8")
            records["class"] = np.repeat(batch.column("class").to_numpy(), sizes)
            yield records, (mixed(records["token"]) % np.uint64(buckets)).astype(np.int32)

    return lambda batches: flushed(pieces(batches))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), len(sorted_values)] if len(sorted_values) else np.zeros(1, np.int64)


def _meet(buckets: int):
    """Tokens that more than one class has, back to their classes."""

    def step(records):
        records = records[np.argsort(records["token"], kind="stable")]
        at = _runs(records["token"])
        k = np.repeat(np.diff(at), np.diff(at))
        records, k = records[k > 1], k[k > 1]
        out = np.zeros(len(records), SHARED)
        out["class"], out["token"], out["k"] = records["class"], records["token"], k
        return out, (mixed(out["class"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)

    return step


def _assign(rule: Rule, shard: int, buckets: int):
    """Classes that enough shared tokens keep in play, with group and roles, as matrix records by token."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = unpacked(left.column("records"), SHARED)
        ids, n = right.column("class").to_numpy(), right.column("n").to_numpy()
        q_last = right.column("q_last").to_numpy().view(np.uint64)
        order = np.argsort(ids)
        ids, n, q_last = ids[order], n[order], q_last[order]
        shared = shared[np.lexsort((shared["token"], -shared["k"], shared["class"]))]
        at = _runs(shared["class"])
        if len(at) == 1 or not len(ids):
            return pa.table({"bucket": pa.array([], pa.int32()), "records": pa.array([], pa.binary())})
        heads, sizes = at[:-1], np.diff(at)
        where = np.searchsorted(ids, shared["class"][heads])
        n, q_last = n[where], q_last[where]
        in_query = (shared["token"] <= np.repeat(q_last, sizes)).astype(np.int64)
        query = np.add.reduceat(in_query, heads) >= rule.slack(n)
        member = sizes >= rule.slack(rule.least(n))
        top, k = shared["token"][heads], shared["k"][heads]
        salt = mixed(shared["class"][heads].view(np.uint64)) % (-(-k // shard)).astype(np.uint64)
        group = mixed(top + salt * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        role = member * MEMBER + query * QUERY
        out = np.zeros(len(shared), MATRIX)
        out["token"], out["class"], out["group"] = shared["token"], shared["class"], np.repeat(group, sizes)
        out["need"] = np.repeat(rule.slack(n), sizes)
        row_role = np.repeat(role, sizes)
        out["role"] = (row_role & MEMBER) | np.where(in_query > 0, row_role & QUERY, 0)
        out["role"][heads] |= np.where(member, FIRST, 0)
        out = out[row_role > 0]
        return pa.Table.from_batches([packed(out, (mixed(out["token"]) % np.uint64(buckets)).astype(np.int32))])

    return run


def _bound(buckets: int):
    """For each token: which groups' unions have it, and so one hit for each query and group."""

    def step(records):
        records = records[np.lexsort((records["group"], records["token"]))]
        at = _runs(records["token"])
        found, size = [], 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            run = records[a:b]
            queries, members = run[run["role"] & QUERY > 0], run[run["role"] & MEMBER > 0]
            if not len(queries) or not len(members):
                continue
            g = _runs(members["group"])
            groups, count, sole = members["group"][g[:-1]], np.diff(g), members["class"][g[:-1]]
            step = max(1, HIT_BYTES // (HIT.itemsize * len(groups)))
            for first in range(0, len(queries), step):
                q = queries[first : first + step]
                hit = (count[None, :] > 1) | (sole[None, :] != q["class"][:, None])
                i, j = np.nonzero(hit)
                out = np.zeros(len(i), HIT)
                out["class"], out["group"], out["need"], out["hits"] = q["class"][i], groups[j], q["need"][i], 1
                found.append(out)
                size += out.nbytes
                # Tokens of one family hit the same pairs again and again: count before they pile up.
                if size > HIT_BYTES:
                    found = [_count_hits(np.concatenate(found))]
                    size = 0
        out = _count_hits(np.concatenate(found) if found else np.zeros(0, HIT))
        return out, (mixed(out["class"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)

    return step


def _count_hits(hits: np.ndarray) -> np.ndarray:
    hits = hits[np.lexsort((hits["group"], hits["class"]))]
    if not len(hits):
        return hits
    first = np.flatnonzero(np.r_[True, (hits["class"][1:] != hits["class"][:-1]) | (hits["group"][1:] != hits["group"][:-1])])
    out = hits[first].copy()
    out["hits"] = np.add.reduceat(hits["hits"], first)
    return out


def _opened(table: pa.Table) -> pa.Table:
    """Queries and the groups that their bound lets them open."""
    hits = _count_hits(unpacked(table.column("records"), HIT))
    hits = hits[hits["hits"] >= hits["need"]]
    return pa.table({"class": pa.array(hits["class"]), "group": pa.array(hits["group"])})


def _members(table: pa.Table) -> pa.Table:
    """Member classes with their groups, each from its record of the group's own token."""
    m = unpacked(table.column("records"), MATRIX)
    m = m[(m["role"] & FIRST) > 0]
    return pa.table({"class": pa.array(m["class"]), "group": pa.array(m["group"])})


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def _verify(rule: Rule):
    """A spanning forest of the links between the visitors and the members of one shard."""

    def run(table: pa.Table) -> pa.Table:
        role, ids, n = table.column("role").to_numpy(), table.column("class").to_numpy(), table.column("n").to_numpy()
        data, bounds = column_bytes(table.column("tokens"))
        sets = [data[a:b].view("<u8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        rows = np.flatnonzero(role == MEMBER)
        nodes = {c: i for i, c in enumerate(dict.fromkeys(ids.tolist()))}
        root = np.arange(len(nodes))
        node = np.array([nodes[c] for c in ids.tolist()])
        index = {}

        def indexed(whole: bool):
            if whole not in index:
                parts = [sets[r] if whole else sets[r][: rule.member_prefix(int(n[r]))] for r in rows]
                tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                order = np.argsort(tokens, kind="stable")
                index[whole] = tokens[order], owner[order]
            return index[whole]

        def counts(tokens: np.ndarray, whole: bool) -> np.ndarray:
            all_tokens, owner = indexed(whole)
            low, high = np.searchsorted(all_tokens, tokens), np.searchsorted(all_tokens, tokens, "right")
            size = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            return np.bincount(owner[at], minlength=len(rows))

        member_n, member_node = n[rows], node[rows]
        a, b = [], []
        for v in np.flatnonzero(role == QUERY)[np.argsort(n[role == QUERY], kind="stable")]:
            size = int(n[v])
            hits = counts(sets[v][: rule.query_prefix(size)], False)
            fit = (hits >= rule.slack(size)) & (member_n >= size) & (rule.percent * member_n <= 100 * size) & (member_node != node[v])
            close = np.flatnonzero(fit)
            close = close[np.argsort(-hits[close], kind="stable")]
            exact, tries = None, 0
            for j in close:
                if root[member_node[j]] == root[node[v]]:
                    continue
                tries += 1
                if tries > FIRST_TRIES and exact is None:
                    exact = counts(sets[v], True)
                o = exact[j] if exact is not None else _overlap(sets[v], sets[rows[j]])
                if rule.linked(int(o), size, int(member_n[j])):
                    a.append(ids[v])
                    b.append(ids[rows[j]])
                    root[root == root[node[v]]] = root[member_node[j]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_components(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    return _labelled(docs, **kw).select("doc_id", "n_shingles", "component_id")


def _labelled(
    docs: DataFrame, shingle: int = 4, percent: int = 85, shard: int = SHARD, bucket_bytes: int = BUCKET_BYTES, set_bytes: int = SET_BYTES
) -> DataFrame:
    """As near_components, with a hash of the text and whether the row's class leads its component."""
    rule, spark = Rule(percent), docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = part_count(docs, bucket_bytes)
    as_bytes = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    sketch = written(as_bytes.mapInArrow(_sketch(shingle), "doc_id long, h long, n long, s1 long, s2 long, range int, counts binary"), "sketch")
    level = spark.sparkContext.broadcast(levels(sketch))
    rows = sketch.filter(F.col("range").isNull()).select("doc_id", "h", "n", "s1", "s2")
    key = ["n", "s1", "s2"]

    tokens = _token_rows(docs, shingle, level, False, rule).groupBy(*key).agg(F.first("q_last").alias("q_last"), F.first("tokens").alias("tokens"))
    least = rows.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("least_id"))
    classes = written(tokens.join(least, key).select(F.monotonically_increasing_id().alias("class"), "*"), "classes")

    by_token = classes.select("class", "tokens").mapInArrow(_explode_tokens(buckets), PACKED)
    shared = regrouped(by_token, TOKEN, _meet(buckets))
    sizes = classes.select("class", "n", "q_last").mapInArrow(_class_buckets(buckets), "bucket int, class long, n long, q_last long")
    matrix = written(shared.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(_assign(rule, shard, buckets), PACKED), "matrix")
    hits = regrouped(matrix, MATRIX, _bound(buckets))
    opened = cut_lineage(hits.groupBy("bucket").applyInArrow(_opened, "class long, group long"))
    members = cut_lineage(matrix.groupBy("bucket").applyInArrow(_members, "class long, group long"))

    in_play = opened.select("class").union(members.join(opened.select("group").distinct(), "group", "left_semi").select("class")).distinct()
    chosen = cut_lineage(in_play.join(classes.select("class", "least_id", *key), "class"))
    few = chosen.count() <= BROADCAST_CLASSES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    some = docs.alias("d").join(small(chosen.select("least_id").distinct()).alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.least_id")), "left_semi")
    sets = _token_rows(some, shingle, level, True, rule).join(small(chosen.select("class", *key)), key).dropDuplicates(["class"])
    sets = written(sets.select("class", "n", "tokens"), "sets")

    sizes = chosen.select("class", "n")
    opened, members = opened.join(small(sizes), "class"), members.join(small(sizes), "class")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / shard, F.sum("n") * 8 / set_bytes)).cast("int")
    cut = opened.groupBy("group").agg(parts.alias("chunks")).join(members.groupBy("group").agg(parts.alias("shards")), "group")
    some_of = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visitors = opened.join(cut, "group").select("class", "group", some_of("chunks").alias("chunk"), each_of("shards").alias("shard"), F.lit(QUERY).alias("role"))
    hosts = members.join(cut, "group").select("class", "group", each_of("chunks").alias("chunk"), some_of("shards").alias("shard"), F.lit(MEMBER).alias("role"))
    tasks = visitors.union(hosts).join(sets, "class")
    edges = tasks.groupBy("group", "chunk", "shard").applyInArrow(_verify(rule), "a long, b long")
    roots = components(edges)

    named = classes.select("class", "least_id", *key).join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    first = F.min(F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", *key)).alias("lead")
    leads = F.struct(*key) == F.struct(*[F.col(f"lead.{c}").alias(c) for c in key])
    label = named.join(named.groupBy("root").agg(first), "root").select(*key, F.col("lead.least_id").alias("component_id"), leads.alias("leads"))
    full = rows.filter("n > 0").join(label, key).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "h", "leads")
    return full.union(rows.filter("n = 0").select("doc_id", "n", "doc_id", "h", F.lit(True)))


def _class_buckets(buckets: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("class").to_numpy()
            bucket = (mixed(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.record_batch([pa.array(bucket), *batch.columns], names=["bucket", "class", "n", "q_last"])

    return run


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of each component, and rows without words.

    Ids need not be unique: a row is known by id and text, so a near copy under the id of a row that stays goes. Rows equal in both stay.
    """
    lead = _labelled(docs, **kw).filter(F.col("leads") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = lead.select(F.col("doc_id").alias("stays"), F.col("h").alias("as_text")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["stays"]) & (F.xxhash64(docs["text"]) == found["as_text"]), "left_semi")


def op4(spark, sf_dir) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
