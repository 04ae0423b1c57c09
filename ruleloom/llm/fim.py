"""Fill-in-middle transformation by piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its text and the sentinels. The
text begins as one descriptor; cutting splits it into prefix, middle and suffix without copying a byte. An arrangement is
a permutation of the descriptors of prefix, middle, suffix and the three sentinels; the output and its hash stream the
arranged descriptors. To restore, the sentinels of an output are located, which makes six descriptors over the output
alone, and the inverse permutation puts them back.

Cut places, form and order come from the SHA-256 of seed and doc_id, so reruns agree. Texts that hold a sentinel stay
plain, and no sentinel overlaps itself or another, so the first match of each is the inserted one.

Null texts count as empty; empty texts are plain. Texts of any length pass whole, one at a time: cut places are found
block by block, so memory is a few copies of one text. A null doc_id hashes as an empty id. Rows with equal ids are cut
by the same digest, repeated rows give repeated results. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.text import column_bytes, ranges

SENTINELS = (b"<P>", b"<S>", b"<M>")
SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
TEXT, MARKS = 0, 1
#: Places of prefix, middle, suffix and the sentinels <P>, <S>, <M> in the descriptor list of a cut document.
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)
ARRANGED = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}
BLOCK = 1 << 20


class PieceTable:
    """Descriptors over immutable buffers; a descriptor may be empty."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, buffers: tuple[memoryview, ...], pieces: list[tuple[int, int, int]]) -> None:
        self.buffers, self.pieces = buffers, pieces

    def cut(self, piece: int, at: int) -> None:
        """Splits a descriptor ``at`` bytes after its start."""
        buffer, start, length = self.pieces[piece]
        self.pieces[piece : piece + 1] = [(buffer, start, at), (buffer, start + at, length - at)]

    def permuted(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def bytes(self) -> bytes:
        return b"".join(self.stream())

    def digest(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(order.index(i) for i in range(len(order)))


def code_points(data: np.ndarray) -> int:
    """Bytes that continue no code point."""
    return sum(int(np.count_nonzero((data[i : i + BLOCK] & 0xC0) != 0x80)) for i in range(0, len(data), BLOCK))


def byte_of(data: np.ndarray, k: int) -> int:
    """Where code point ``k`` begins; the end, if there are only ``k``."""
    for i in range(0, len(data), BLOCK):
        begins = np.flatnonzero((data[i : i + BLOCK] & 0xC0) != 0x80)
        if k < len(begins):
            return i + int(begins[k])
        k -= len(begins)
    return len(data)


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return struct.unpack(">4I", digest[:16])


def split(data: np.ndarray, doc_id: int | None, seed: str, plain_from: int, spm_below: int) -> tuple[PieceTable, int, str, int | None, int | None]:
    """The arranged piece table of a text, its code points, form, and the code points of prefix and middle."""
    raw = data.tobytes()
    n = len(raw) if raw.isascii() else code_points(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    table = PieceTable((memoryview(raw), memoryview(b"".join(SENTINELS))), [(TEXT, 0, len(raw))])
    if not raw or h3 % 100 >= plain_from or any(mark in raw for mark in SENTINELS):
        return table, n, "plain", None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (low, high) if n == len(raw) else (byte_of(data, low), byte_of(data, high))
    table.cut(0, first)
    table.cut(1, second - first)
    at = 0
    for mark in SENTINELS:
        table.pieces.append((MARKS, at, len(mark)))
        at += len(mark)
    form = "spm" if h4 % 100 < spm_below else "psm"
    return table.permuted(ARRANGED[form]), n, form, low, high - low


def restored(output: bytes, form: str) -> PieceTable:
    """The text behind an output, as descriptors over it."""
    table = PieceTable((memoryview(output),), [(TEXT, 0, len(output))])
    if form == "plain":
        return table
    order = ARRANGED[form]
    for piece in order[::2]:
        mark, start = SENTINELS[piece - P], table.pieces[-1][1]
        at = output.index(mark, start)
        table.cut(len(table.pieces) - 1, at - start)
        table.cut(len(table.pieces) - 1, len(mark))
    # What stands before the first sentinel is empty; the rest is in the order of the form.
    table.pieces = table.pieces[1:]
    return table.permuted(inverse(order)[:P])


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _transformed(seed: str, plain_from: int, spm_below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in ranges(bounds):
                rows = [split(data[bounds[i] : bounds[i + 1]], ids[i], seed, plain_from, spm_below) for i in range(a, b)]
                yield pa.record_batch(
                    [
                        pa.array(ids[a:b], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.string()),
                        pa.array([r[3] for r in rows], pa.int64()),
                        pa.array([r[4] for r in rows], pa.int64()),
                        _texts([r[0].bytes() for r in rows]),
                        pa.array([r[0].digest() for r in rows], pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"],
                )

    return run


FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def fill_in_middle(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_transformed(seed, plain_from, spm_below), FORMS)


def restore(outputs: DataFrame, with_text: bool = True) -> DataFrame:
    """The columns of ``outputs`` (form, output, others) without output, and ``restored_sha256``; ``text`` too if asked for."""
    kept = [f for f in outputs.schema.fields if f.name not in ("output", "text", "restored_sha256")]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + (", text string" if with_text else "") + ", restored_sha256 string"
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            data, bounds = column_bytes(batch.column("__output"))
            forms = batch.column("form").to_pylist()
            for a, b in ranges(bounds):
                tables = [restored(data[bounds[i] : bounds[i + 1]].tobytes(), forms[i]) for i in range(a, b)]
                columns = [batch.column(c).slice(a, b - a) for c in names]
                if with_text:
                    columns.append(_texts([t.bytes() for t in tables]))
                columns.append(pa.array([t.digest() for t in tables], pa.string()))
                yield pa.record_batch(columns, names=[*names, *(["text"] if with_text else []), "restored_sha256"])

    return outputs.select(*[f"`{c}`" for c in names], F.col("output").cast("binary").alias("__output")).mapInArrow(run, kind)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, length(t) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS b, substr(t, hi + 1) AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op11(spark, sf_dir) -> DataFrame:
    return restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")), with_text=False)
