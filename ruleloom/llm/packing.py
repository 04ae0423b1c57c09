"""Fixed-width records packed into binary rows, one per bucket: far fewer rows to shuffle than records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKED = "bucket int, records binary"
FLUSH_BYTES = 16 << 20


def packed(records: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that has records."""
    order = np.argsort(bucket, kind="stable")
    bucket, raw = bucket[order], records[order].tobytes()
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    bounds = np.r_[first, len(bucket)] * records.dtype.itemsize
    return pa.record_batch(
        [pa.array(bucket[first].astype(np.int32)), pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary())],
        names=["bucket", "records"],
    )


def unpacked(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype) if len(column) else np.zeros(0, dtype)


def flushed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Packs (records, buckets) pieces, several at a time up to a bound."""
    held, size = [], 0
    for records, bucket in parts:
        if len(records):
            held.append((records, bucket))
            size += records.nbytes
        if size > FLUSH_BYTES:
            yield packed(np.concatenate([r for r, _ in held]), np.concatenate([b for _, b in held]))
            held, size = [], 0
    if held:
        yield packed(np.concatenate([r for r, _ in held]), np.concatenate([b for _, b in held]))


def regrouped(rows: DataFrame, dtype, step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Packed rows to packed rows: ``step`` gets all records of a bucket and returns records with their next buckets."""

    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([packed(*step(unpacked(table.column("records"), dtype)))])

    return rows.groupBy("bucket").applyInArrow(one, PACKED)
