"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text into pieces is found position by position. Only the last positions that a piece can
still reach back to are alive; as soon as the backpointer paths of all of them meet at one boundary, the ids before it are
final and leave the window. So memory follows the longest piece and the ambiguity of the text, not its length; only where
paths never meet, as in one letter repeated for ever, are all backpointers kept.

Where no piece has a blank behind another character (checked when a vocabulary is loaded), all paths meet at the words'
beginnings. In a word they also meet between letters and marks that no piece has side by side, so a text is put together
from parts of words, and the ids of a short part are remembered, up to a bound. Where a part has equally good segmentations,
sums over the whole word decide between them, so such a word is searched as one.

Pieces weigh -ln(2 + rank) where the file holds merge ranks, as byte-pair vocabularies do, and the file's log
probability otherwise. A character without a piece becomes its UTF-8 bytes. Among equal weights the longer last piece
wins. A blank goes before every text that is not empty, and is taken off again. Decoding gives the text back byte by
byte, also where it holds the vocabulary's own blank sign. Null text counts as empty and has no ids.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

VOCABULARY = "piece_bpe_32k.model"
BYTE_WEIGHT = -30.0
REMEMBERED, SHORT = 250_000, 48
CHECK_EVERY = 32
#: Weights that rounding of sums may put in either order.
CLOSE = 1e-6
BLANK = "▁"


def _marks(table) -> set[str]:
    """Characters of longer pieces that no chain of neighbours within pieces leads to a letter."""
    kind: dict[str, str] = {}

    def of(c):
        while kind.setdefault(c, c) != c:
            c = kind[c]
        return c

    for piece in table:
        inside = piece.lstrip(" ")
        for a, b in zip(inside, inside[1:]):
            kind[of(a)] = of(b)
    lettered = {of(c) for c in list(kind) if c.isalpha()}
    return {c for c in list(kind) if of(c) not in lettered and c != " "}


class Pieces:
    """A vocabulary's pieces with their weights."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        sp = SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        ranked = all(sp.get_score(i) == int(sp.get_score(i)) for i in normal)
        self.table = {}
        self.raw = [b""] * sp.get_piece_size()
        for i in normal:
            piece, score = sp.id_to_piece(i).replace(BLANK, " "), sp.get_score(i)
            self.table[piece] = (-math.log(2 - score) if ranked else score, (i,))
            self.raw[i] = piece.encode()
        self.bytes = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes[value], self.raw[i] = i, bytes([value])
        if len(self.bytes) != 256:
            raise ValueError(f"{vocabulary} has no byte pieces")
        #: Beginnings of pieces, with weight and ids where they are pieces themselves.
        self.heads = dict.fromkeys(p[:n] for p in self.table for n in range(1, len(p) + 1)) | self.table
        self.longest = max(map(len, self.table))
        self.by_words = not any(" " in p.lstrip(" ") for p in self.table)
        inner = "".join(sorted({c for p in self.table if len(p) > 1 for c in p if c.isspace() and c != " "}))
        # Words with the blanks before them, blanks alone, and white space that is in no longer piece, each by itself.
        self.split = re.compile(rf" *(?:[^\s]|[{re.escape(inner)}])+| +|\s" if inner else r" *[^\s]+| +|\s")
        # The same with words cut into letters and marks.
        marks = _marks(self.table)
        inner, marks = re.escape("".join(sorted(set(inner) - marks))), re.escape("".join(sorted(marks)))
        letters = rf"(?:[^\s{marks}]|[{inner}])+" if inner else rf"[^\s{marks}]+"
        self.parts = re.compile(rf" *{letters}" + (rf"| *[{marks}]+" if marks else "") + r"| +|\s")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.undecided: set[str] = set()

    def byte_ids(self, character: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in character.encode("utf-8", "surrogateescape"))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if not text:
            return b""
        if not self.by_words:
            return self._searched(" " + text)
        parts = self.parts.findall(" " + text)
        out = list(map(self.words.get, parts))
        if None in out:
            out = [self._part(part) if ids is None else ids for part, ids in zip(parts, out)]
            if None in out:
                out = list(map(self._word, self.split.findall(" " + text)))
        return b"".join(out)

    def _searched(self, word: str) -> bytes:
        found = list(Viterbi(self).run(word))
        return struct.pack(f"<{len(found)}I", *found)

    def _known(self, word: str) -> bytes | None:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is not None:
                self._remember(word, ids)
        return ids

    def _remember(self, word: str, ids: bytes) -> None:
        if len(word) <= SHORT:
            if len(self.words) >= REMEMBERED:
                self.words, self.older = {}, self.words
            self.words[word] = ids

    def _part(self, part: str) -> bytes | None:
        """Ids of a part, unless it may stand behind another one and what stands before it decides between segmentations."""
        ids = self._known(part)
        if ids is None and part not in self.undecided:
            if part[0] == " " or self._decided(part):
                ids = self._searched(part)
                self._remember(part, ids)
            elif len(part) <= SHORT:
                if len(self.undecided) >= REMEMBERED:
                    self.undecided = set()
                self.undecided.add(part)
        return ids

    def _word(self, word: str) -> bytes:
        ids = self._known(word)
        if ids is None:
            parts = list(map(self._part, self.parts.findall(word)))
            if None not in parts:
                return b"".join(parts)
            ids = self._searched(word)
            self._remember(word, ids)
        return ids

    def _decided(self, part: str) -> bool:
        """Whether no beginning of a part has two segmentations of about the same weight."""
        weight = [0.0]
        for end in range(1, len(part) + 1):
            last = part[end - 1]
            options = [weight[k] + self.table[part[k:end]][0] for k in range(max(0, end - self.longest), end) if part[k:end] in self.table]
            if last not in self.table:
                options.append(weight[-1] + BYTE_WEIGHT * len(self.byte_ids(last)))
            options.sort()
            if len(options) > 1 and options[-1] - options[-2] < CLOSE:
                return False
            weight.append(options[-1])
        return True

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))[1:]


class Viterbi:
    """One text, character by character. ``widest`` is the most boundaries that were ever held."""

    def __init__(self, pieces: Pieces) -> None:
        self.p, self.widest = pieces, 0

    def run(self, text: str):
        """Ids of the best segmentation, each as soon as it is final."""
        heads, reach, n = self.p.heads, self.p.longest, len(text)
        base, limit = 0, reach + CHECK_EVERY  # boundaries before ``base`` are final
        held = min(n, limit + reach + 1) + 1
        weight, back = [-math.inf] * held, [None] * held  # of the boundaries from ``base`` on: best weight; boundary before and ids
        weight[0] = 0.0
        for start in range(n):
            k = start - base
            here = weight[k]
            end = start + 1
            part = text[start]
            found = heads.get(part)
            if found is None:
                ids = self.p.byte_ids(part)
                found = BYTE_WEIGHT * len(ids), ids
            k += 1
            if here + found[0] > weight[k]:
                weight[k], back[k] = here + found[0], (start, found[1])
            while end < n:
                end += 1
                part = text[start:end]
                if part not in heads:
                    break
                k += 1
                found = heads[part]
                if found is not None and here + found[0] > weight[k]:
                    weight[k], back[k] = here + found[0], (start, found[1])
            if start - base > limit:
                self.widest = max(self.widest, start - base)
                met = self._meeting(back, weight, base, start + 1)
                if met > base:
                    yield from self._path(back, base, met)
                    del weight[: met - base], back[: met - base]
                    base, limit = met, reach + CHECK_EVERY
                else:
                    limit *= 2
                more = min(n - base, max(limit, start - base) + reach + 1) + 1 - len(weight)
                weight += [-math.inf] * more
                back += [None] * more
        yield from self._path(back, base, n)

    @staticmethod
    def _meeting(back, weight, base, first):
        """The boundary where the paths of all live boundaries, from ``first`` on, have met."""
        alive = {k for k in range(first, base + len(weight)) if weight[k - base] > -math.inf}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last - base][0])
        return alive.pop()

    @staticmethod
    def _path(back, base, end):
        steps = []
        while end > base:
            end, ids = back[end - base]
            steps.append(ids)
        for ids in reversed(steps):
            yield from ids


_loaded: dict[str, Pieces] = {}


def pieces(vocabulary: str = VOCABULARY) -> Pieces:
    """One for each worker process; what it remembers is bounded."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Pieces(vocabulary)
    return _loaded[vocabulary]


def _encoded(batch: pa.RecordBatch, p: Pieces):
    for text in batch.column("text"):
        raw = text.as_py() or b""
        yield raw, p.encode(raw.decode("utf-8", "surrogateescape"))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every row."""

    def run(batches):
        p = pieces(vocabulary)
        for batch in batches:
            ids = [x for _, x in _encoded(batch, p)]
            bounds = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of every row with ids; a null list gives an empty text."""

    def run(batches):
        p = pieces(vocabulary)
        for batch in batches:
            texts = [p.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    found = rows.mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.BinaryType())]))
    return found.select("doc_id", F.col("text").cast("string").alias("text"))


def round_trips(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of 32-bit little-endian ids), decoded_sha256, round_trip of every row; its ids if asked."""

    def run(batches):
        p = pieces(vocabulary)
        for batch in batches:
            rows, held = [], []
            for raw, ids in _encoded(batch, p):
                text = p.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(text).hexdigest(), text == raw))
                held.append(ids)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)]
            names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"]
            if with_ids:
                bounds = np.cumsum([0, *[len(x) // 4 for x in held]]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(held), "<i4"))))
                names.append("ids")
            yield pa.record_batch([batch.column("doc_id"), *columns], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return rows.mapInArrow(run, kind + ", ids array<int>" * with_ids)


def op3(spark, sf_dir) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
