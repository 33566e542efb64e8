"""Routing of many small keyed entries through Spark as packed rows.

A mapper's entries (key, id, aux) are sorted by bucket (key modulo the number of buckets) and shipped as one binary row
for each bucket and flush, so that the shuffle moves few rows; the reducer of a bucket sorts its entries with numpy.
The number of buckets follows the number of entries, so a bucket's size doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

ENTRY = np.dtype([("key", "<u8"), ("id", "<u8"), ("aux", "<u8")])
#: Entries that a mapper holds before it ships them, and that a bucket should have.
FLUSH, PER_BUCKET = 1 << 19, 1 << 19
SCHEMA = "bucket long, entries binary"
#: A count sketch's counters (a power of two), and the parts that it travels in.
SKETCH_BITS, SKETCH_PARTS = 20, 64
SKETCH_SCHEMA = "part int, counts binary"


class Shipper:
    """Collects entries and turns them into packed rows."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, key: np.ndarray, ident: np.ndarray, aux: np.ndarray, salt: np.ndarray | None = None) -> None:
        part = np.empty(len(key), ENTRY)
        part["key"], part["id"], part["aux"] = key, ident, aux
        bucket = key if salt is None else key + salt
        self.parts.append((part, (bucket % np.uint64(self.buckets)).astype(np.int64)))
        self.held += len(part)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        entries, bucket = np.concatenate([p for p, _ in self.parts]), np.concatenate([b for _, b in self.parts])
        self.parts, self.held = [], 0
        order = np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by radix
        entries, bucket = entries[order], bucket[order]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int64()), pa.array([entries[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["bucket", "entries"])


def unpacked(blobs) -> tuple[np.ndarray, np.ndarray]:
    """(distinct entries sorted by key, aux and id; edges of the runs of one key)."""
    entries = np.frombuffer(b"".join(blobs), ENTRY)
    order = np.argsort(entries["key"])
    key = entries["key"][order]
    equal = np.concatenate([[False], key[1:] == key[:-1], [False]])
    tied = np.flatnonzero(equal[1:] | equal[:-1])  # most keys have one entry, and need no second look
    if len(tied):
        ties = entries[order[tied]]
        order[tied] = order[tied][np.lexsort((ties["id"], ties["aux"], ties["key"]))]
    entries = entries[order]
    if len(entries):
        entries = entries[np.concatenate([[True], entries[1:] != entries[:-1]])]
    change = np.flatnonzero(entries["key"][1:] != entries["key"][:-1]) + 1 if len(entries) else np.zeros(0, np.int64)
    return entries, np.concatenate([[0], change, [len(entries)]]) if len(entries) else np.zeros(1, np.int64)


def sketch_rows(counts: np.ndarray) -> pa.RecordBatch:
    """A task's count sketch in parts."""
    parts = np.minimum(counts, 2**31 - 1).astype("<i4").reshape(SKETCH_PARTS, -1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])


def summed(sketches: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches, of fixed size, on the driver. Counters are shared by hash, so a count may be too large, never too small."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
        for b in frame["counts"]:
            total += np.frombuffer(b, "<i4")
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int32)
    for r in sketches.groupBy("part").applyInPandas(add, SKETCH_SCHEMA).collect():
        out[r["part"]] = np.frombuffer(r["counts"], "<i4")
    return out.ravel()
