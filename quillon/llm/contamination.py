"""Test items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's signature is the smallest hashes (bottom-k MinHash) of its distinct word shingles. Items are parted by size,
and a partition's signature length is the number of shingles that its largest item may miss, plus one: a document with
the asked-for containment then shares at least one signature hash with the item, so no match is lost, however long the
document. Documents are streamed against the signatures; for those that hit one, the item's shingles found are counted
and then compared as text. Items are taken in blocks of a checked size, one broadcast each, so the item side may grow.

Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased; an item or document with fewer words than a
shingle has its whole sequence as its one shingle. Defined results: null or empty items and documents match nothing;
repeated items and documents match each; other columns are dropped; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .runtime import released, text_chunks

BLOCK_BYTES = 8 << 20
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def needed(size: int, percent: int) -> int:
    """The fewest of `size` shingles that make up `percent` per cent."""
    return (size * percent + 99) // 100


def signature_length(size: int, percent: int) -> int:
    """For the partition of sizes up to the next power of two: the shingles that its largest item may miss, plus one."""
    top = 1 << max(0, size - 1).bit_length()
    return top - needed(top, percent) + 1


class Items:
    """A block of test items: shingle hashes, signatures and texts."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, percent: int):
        self.size, self.percent, self.ids = size, percent, [i for i, _ in items]
        sets, signatures, self.texts = [], [], []
        for _, text in items:
            data = np.frombuffer(text, np.uint8)
            own = np.unique(hashing.shingle_hashes(*hashing.word_hashes(data, np.array([0, len(data)])), size)[0])
            words = text.translate(_FOLD).split()
            self.texts.append({b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
            sets.append(own)
            signatures.append(own[: signature_length(len(own), percent)] if len(own) else own)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], owner[order]
        self.signature = np.unique(np.concatenate(signatures)) if signatures else flat
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.signature & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles shared) of a run of texts."""
        starts, ends, word_rows = hashing.words(data, offsets)
        hashes, rows = hashing.shingle_hashes(hashing.span_hashes(hashing.LOWER[data], starts, ends), word_rows, self.size)
        near = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        near = near[np.isin(hashes[near], self.signature)]
        for r in np.unique(np.searchsorted(rows, near, "right") - 1):
            own, at = np.unique(hashes[rows[r] : rows[r + 1]], return_index=True)
            left, right = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
            hit = right > left
            width = (right - left)[hit]
            places = np.repeat(left[hit] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            items, words = self.owner[places], np.repeat(at[hit], width) + word_rows[r]
            shared = np.bincount(items, minlength=len(self.ids))
            for item in np.flatnonzero((shared > 0) & (shared * 100 >= self.sizes * self.percent)):
                found = set()
                for w in words[items == item]:
                    last = min(w + self.size, word_rows[r + 1]) - 1
                    found.add(b" ".join(data[starts[w] : ends[last]].tobytes().translate(_FOLD).split()))
                exact = len(found & self.texts[item])
                if exact * 100 >= len(self.texts[item]) * self.percent:
                    yield int(r), int(item), exact


def find_contamination(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, item, n_item, n_shared and containment of each document that holds at least `percent` per cent of an item's shingles; no shuffle."""
    spark = documents.sparkSession
    tests = benchmark.select(F.col(item).cast("long").alias("item"), F.encode(F.coalesce(F.col(item_text), F.lit("")), "UTF-8").alias("text"))
    total = tests.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = int(total // block_bytes) + 1
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "key long, item long, n_item long, n_shared long, containment double"

    def one(block: int) -> DataFrame:
        collected = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Items([(r["item"], bytes(r["text"])) for r in collected], size, percent))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            released()
            items = shared.value
            for batch in batches:
                out = []
                for row, data, offsets in text_chunks(batch.column(1)):
                    out += [(row + r, i, n) for r, i, n in items.matches(data, offsets)]
                sizes = [len(items.texts[i]) for _, i, _ in out]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _, _ in out], pa.int64())), pa.array([items.ids[i] for _, i, _ in out], pa.int64()), pa.array(sizes, pa.int64()), pa.array([n for _, _, n in out], pa.int64()), pa.array([n / s for (_, _, n), s in zip(out, sizes)], pa.float64())], ["key", "item", "n_item", "n_shared", "containment"])

        return rows.mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
    return found.withColumnsRenamed({"key": key, "item": item})


#: DuckDB SQL for find_contamination() on documents and benchmark.
SQL = r"""
WITH texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row_id, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
words AS (
  SELECT kind, row_id, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM texts WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT kind, row_id, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT row_id, count(*) AS n_item FROM shingles WHERE kind = 1 GROUP BY row_id),
shared AS (
  SELECT d.id AS doc_id, d.row_id AS d_row, i.id AS item_id, i.row_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 0 AND i.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (row_id) WHERE n_shared * 100 >= n_item * 80
"""
