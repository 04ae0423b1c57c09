"""Token ids in fixed-width bit-packed blocks.

An id takes as many bits as the vocabulary needs. Sixty-four ids fill as many 64-bit words as an id has bits, so packing
and unpacking are a few shifts over whole columns, and any id is found by its number alone.

A file set is a Parquet folder, a row for each block: shard, block, first_id (ids of the shard before it), n_ids, bits,
doc_ids, doc_ends (offsets of the documents' ends in the block) and the packed payload. Blocks hold whole documents and
close at BLOCK_IDS or more. Shards are ranges of doc_id, so shard, block and place in the block give ascending doc_id; a
shard's place among all ids follows from the shards' totals, one number for each.

Encoding cuts runs of characters between blanks where the vocabulary does, into Latin-1 words, punctuation and digits, and
remembers the ids of each: new words and punctuation go to the tokenizer joined by blanks and are told apart by its
end-of-word pieces. A run with any other character is one part and goes to it alone.

Null text counts as empty and is the end id alone. Rows with equal ids stand in order of their text, null ids first.
Extra columns are not read; an empty table gives no blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ruleloom.llm.storage import part_count, shared_path
from ruleloom.llm.text import column_bytes, ranges

VOCABULARY, END_ID = "word_bpe_49k.json", 1
BLOCK_IDS = 1 << 16
SHARD_BYTES = 32 << 20
CACHED = 250_000
#: Characters that part words in the vocabulary's own splitting; the apostrophe begins contractions and is left out.
PUNCTUATION = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Letters that lower-casing and composition keep apart from their neighbours.
LETTERS = "a-zA-Z" + "".join(c for c in map(chr, range(0x80, 0x100)) if c.isalpha())
PLAIN = LETTERS + PUNCTUATION + "0-9"
#: A run with another character, whole; or else a word, punctuation or a digit.
PARTS = re.compile(rf"[{PLAIN}]*+[^{PLAIN} \t-\r][^ \t-\r]*|[{LETTERS}]+|[{PUNCTUATION}]+|[0-9]")
BATCHED = re.compile(rf"[{LETTERS}]+|[{PUNCTUATION}]+")
#: How special tokens begin; runs with it go to the tokenizer alone and as they are.
SPECIAL = b"<|"
LANES = 64


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    n = -(-len(ids) // LANES)
    padded = np.zeros(n * LANES, np.uint64)
    padded[: len(ids)] = ids
    columns = padded.reshape(n, LANES)
    out = np.zeros((n, bits), np.uint64)
    for k in range(LANES):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= columns[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= columns[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a block; only the words around them are read."""
    words = np.frombuffer(payload, "<u8").reshape(-1, bits)
    count = len(words) * LANES - start if count is None else count
    first, last = start // LANES, -(-(start + count) // LANES)
    words = words[first:last]
    out = np.zeros((len(words), LANES), np.uint64)
    for k in range(LANES):
        word, shift = divmod(k * bits, 64)
        out[:, k] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            out[:, k] |= words[:, word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << bits) - 1)
    return out.ravel()[start - first * LANES :][:count].astype(np.uint32)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        if not all(t.content.encode().startswith(SPECIAL) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"special tokens of {vocabulary} must begin with {SPECIAL.decode()}")
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def parts(text: bytes) -> list[str]:
        """A text as the vocabulary parts it. It lower-cases, so A-Z may be lower-cased beforehand unless a special token could come of it."""
        if SPECIAL not in text:
            return PARTS.findall(text.lower().decode())
        return [x for run in text.split() for x in ([run.decode()] if SPECIAL in run else PARTS.findall(run.lower().decode()))]

    def _learn(self, new: set[str]) -> None:
        """Remembers the ids of parts; words and punctuation are encoded together."""
        known, older, special = self.known, self.older, SPECIAL.decode()
        found = new & older.keys()
        known.update({part: older[part] for part in found})
        new = new - found
        batched = {part: part.lower() for part in new if BATCHED.fullmatch(part) and special not in part}
        words = list(set(batched.values()) - known.keys())
        if words:
            # Lower-case composed words without inner breaks: what the vocabulary's normaliser and splitting leave alone.
            ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words) and stops[-1] == len(ids):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                known.update(zip(words, [raw[a:b] for a, b in zip([0, *stops], stops)]))
            else:
                known.update({w: self.alone(w) for w in words})
        known.update({part: known[word] if (word := batched.get(part)) else self.alone(part) for part in new - known.keys()})

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = list(map(self.parts, texts))
        used = set().union(*split)
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        self._learn(used - self.known.keys())
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each worker process; what it remembers is bounded."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


BLOCK = "shard int, block int, first_id long, n_ids long, bits int, doc_ids array<bigint>, doc_ends array<bigint>, payload binary"


def _blocks(vocabulary: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        bits, shard = bits_for(e.size), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        before, block, ids, ends, held, size = 0, 0, [], [], [], 0

        def row():
            packed = pack(np.frombuffer(b"".join(held), "<u4"), bits)
            values = [[shard], [block], [before], [size], [bits], [ids], [ends], [packed]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "block", "first_id", "n_ids", "bits", "doc_ids", "doc_ends", "payload"]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            data, bounds = column_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in ranges(bounds):
                texts = [data[bounds[i] : bounds[i + 1]].tobytes() for i in range(a, b)]
                for i, raw in zip(range(a, b), e.encode(texts)):
                    held += [raw, end]
                    size += len(raw) // 4 + 1
                    ids.append(doc_ids[i])
                    ends.append(size)
                    if size >= block_ids:
                        yield row()
                        before, block, ids, ends, held, size = before + size, block + 1, [], [], [], 0
        if ids:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> None:
    """The ids of all documents in ascending doc_id order."""
    shards = part_count(docs, shard_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    placed = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(_blocks(vocabulary, end_id, block_ids), BLOCK).write.option("compression", "zstd").parquet(path)


def _shard_starts(blocks: DataFrame) -> dict[int, int]:
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    return dict(zip([s for s, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist()))


def _opened(batches: Iterator[pa.RecordBatch], starts: dict[int, int]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: doc_ids, the documents' starts among all ids, their bounds in the block, and the ids."""
    for batch in batches:
        for r in batch.to_pylist():
            bounds = np.r_[0, r["doc_ends"]].astype(np.int64)
            begin = starts[r["shard"]] + r["first_id"] + bounds[:-1]
            yield pa.array(r["doc_ids"], pa.int64()), begin, bounds, unpack(r["payload"], r["bits"], 0, r["n_ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document, from the files alone."""
    blocks = spark.read.parquet(path)
    starts = _shard_starts(blocks)

    def run(batches):
        for doc_ids, begin, bounds, ids in _opened(batches, starts):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([doc_ids, pa.array(begin), lists], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    blocks = spark.read.parquet(path)
    starts = _shard_starts(blocks)

    def run(batches):
        for doc_ids, begin, bounds, ids in _opened(batches, starts):
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            columns = [doc_ids, pa.array(begin), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(spark, path)
