"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

A document's ids (its tokens and one closing id) give as many full pieces as fit and a shorter rest. Rests are
counted by length class (rounded up to `width` tokens), so the histogram has a bounded size whatever the corpus.
On the driver a linear program over cutting patterns is solved by column generation: the simplex multipliers price
lengths, a knapsack dynamic program finds the best new pattern, until none improves. Patterns are used a rounded-down
number of times; first-fit decreasing takes the few rests left over. Documents are ranked inside their class and
the k-th takes the k-th slot of the class, so the assignment is a lookup; offsets are running sums of real lengths.

Ranks are taken within (bucket, class) with bucket a hash of the document, then shifted by the counts of earlier
buckets, so that a class with a third of all rows is not sorted in one task.

Defined results: null or empty text is the closing id alone; repeated rows are packed each; other columns are dropped;
an empty table gives an empty table; a text of any length is cut into full pieces and a rest.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pretokens
from .runtime import kept, stored, text_chunks

#: Ids that a worker keeps for pre-tokens already merged.
POOL = 8 << 20


class Encoder:
    """Ids by one byte-level vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memory = pretokens.Memory()
        self.pool, self.used = np.zeros(1 << 20, np.int64), 0
        self.vocabulary = {p: i for p, i in self.library.get_vocab(with_added_tokens=False).items()}

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Places of the texts' ids in the pool, as start * 2**24 + length."""
        place = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            ids = [t.id for t in self.library.model.tokenize(pretokens.mapped(text))]
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            place[i] = self.used << 24 | len(ids)
            self.used += len(ids)
        return place

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row and the end)."""
        if self.used > POOL:
            self.memory.clear()
            self.used = 0
        text = pretokens.Codes(data, offsets)
        starts, ends = pretokens.split_bytes(text.codes, text.rows)
        hashes = pretokens.code_hashes(text.codes, starts, ends)
        place, missing = self.memory.find(hashes)
        if len(missing):
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            learnt = self._learn([pretokens.string(text.codes[starts[i] : ends[i]]) for i in first])
            place[missing] = learnt[inverse]
            self.memory.put(new, learnt)
        count = place & 0xFFFFFF
        ends_at = np.cumsum(count)
        flat = self.pool[np.repeat((place >> 24) - (ends_at - count), count) + np.arange(ends_at[-1] if len(ends_at) else 0)]
        ends_at = np.concatenate([[0], ends_at])
        rows = ends_at[np.searchsorted(starts, text.rows, "left")]
        if text.plain.all():
            return flat, rows
        parts = [flat[rows[r] : rows[r + 1]] if text.plain[r] else np.array(self.library.encode(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids, np.int64) for r in range(len(offsets) - 1)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoded(documents: DataFrame, vocabulary: str, size: int, closing: int, key: str, text: str) -> DataFrame:
    """key, tokens (with the closing id) and the CRC-32 of each piece's little-endian 32-bit ids; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("ids", vocabulary), lambda: Encoder(vocabulary))
        for batch in batches:
            tokens, sums = [], []
            for _, data, offsets in text_chunks(batch.column(1)):
                flat, rows = encoder.ids(data, offsets)
                flat = flat.astype("<u4")
                for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                    own = np.append(flat[a:b], np.uint32(closing)).tobytes()
                    tokens.append(b - a + 1)
                    sums.append([zlib.crc32(own[i : i + 4 * size]) for i in range(0, len(own), 4 * size)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["key", "doc_tokens", "crcs"])

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, doc_tokens long, crcs array<long>")


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack's dynamic program: the filling of `capacity` units, lengths 1..len(prices), with the largest price."""
    value, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        reach = min(room, len(prices))
        gain = value[room - reach : room][::-1] + prices[:reach]
        best = int(np.argmax(gain))
        if gain[best] > value[room - 1]:
            value[room], pick[room] = gain[best], best + 1
        else:
            value[room] = value[room - 1]
    pattern, room = np.zeros(len(prices), np.int64), capacity
    while room > 0:
        if pick[room]:
            pattern[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def cutting_patterns(demand: np.ndarray, capacity: int, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """(slots of each length, times used) that cover demand[i] pieces of i+1 units in bins of `capacity` units.

    Revised simplex over patterns, columns by best_pattern(); `rounds` only bounds the driver's work, any stop is feasible.
    """
    lengths = np.flatnonzero(demand > 0)
    if not len(lengths):
        return []
    columns = np.zeros((len(lengths), len(lengths)))
    np.fill_diagonal(columns, capacity // (lengths + 1))
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ demand[lengths]
    for _ in range(rounds):
        prices = np.zeros(len(demand))
        prices[lengths] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = best_pattern(prices, capacity)
        if value <= 1 + 1e-9:
            break
        entering = pattern[lengths].astype(float)
        step = inverse @ entering
        ratio = np.where(step > 1e-10, amount / np.where(step > 1e-10, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        amount -= ratio[out] * step
        amount[out] = ratio[out]
        columns[:, out] = entering
        inverse[out] /= step[out]
        others = np.arange(len(lengths)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    used, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-amount, kind="stable"):
        pattern = np.zeros(len(demand), np.int64)
        pattern[lengths] = np.rint(columns[:, j]).astype(np.int64)
        on = pattern > 0
        times = min(int(np.floor(amount[j] + 1e-7)), int((left[on] // pattern[on]).min())) if on.any() else 0
        if times > 0:
            left -= times * pattern
            used.append((pattern, times))
    while left.any():  # first fit decreasing, bin by bin
        pattern, room = np.zeros(len(demand), np.int64), capacity
        for length in range(len(demand), 0, -1):
            fit = min(int(left[length - 1]), room // length)
            pattern[length - 1] += fit
            room -= fit * length
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        left -= times * pattern
        used.append((pattern, times))
    return used


def pack(documents: DataFrame, vocabulary: str, size: int = 2048, width: int = 8, closing: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = stored(encoded(documents, vocabulary, size, closing, key, text), "token-lengths")
    buckets = max(64, rows.count() // 5000)
    rows = rows.select(
        "*",
        F.expr(f"doc_tokens div {size}").alias("full"),
        (F.col("doc_tokens") % size).alias("rest"),
        F.ceil((F.col("doc_tokens") % size) / width).cast("int").alias("class"),
        F.pmod(F.xxhash64("key", "crcs"), F.lit(buckets)).alias("bucket"),
    )
    classes = -(-size // width)
    demand = np.zeros(classes, np.int64)
    counts = rows.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.sum("full").alias("fulls"))
    for r in counts.where("class > 0").groupBy("class").agg(F.sum("n").alias("n")).collect():
        demand[r["class"] - 1] = r["n"]
    patterns = cutting_patterns(demand, classes)

    slots: dict[int, list[list[int]]] = {c: [] for c in range(1, classes + 1)}  # of each class: first rank, first sequence, slots a sequence, first slot
    filled, sequences = np.zeros(classes, np.int64), 0
    for pattern, times in patterns:
        place = 0
        for c in np.flatnonzero(pattern)[::-1].tolist():
            slots[c + 1].append([int(filled[c]), sequences, int(pattern[c]), place])
            filled[c] += times * pattern[c]
            place += int(pattern[c])
        sequences += times
    table = {c: np.array(x, np.int64) for c, x in slots.items() if x}

    earlier = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = counts.groupBy("bucket").agg(F.sum("fulls").alias("fulls")).withColumn("class", F.lit(-1))
    first = counts.select("bucket", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_rank"))
    first_full = by_bucket.select("bucket", F.coalesce(F.sum("fulls").over(earlier), F.lit(0)).alias("first_full"))
    order = ["key", "doc_tokens", "crcs"]
    ranked = (
        rows.join(first, ["bucket", "class"])
        .join(first_full, "bucket")
        .withColumn("rank", F.col("first_rank") + F.row_number().over(Window.partitionBy("bucket", "class").orderBy(*order)) - 1)
        .withColumn("sequence_full", sequences + F.col("first_full") + F.sum("full").over(Window.partitionBy("bucket").orderBy(*order, "rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
        .select("key", "doc_tokens", "crcs", "full", "rest", "class", "rank", "sequence_full")
    )
    ranked = stored(ranked, "ranked")

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sequence, slot = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            kind, rank = f["class"].to_numpy(), f["rank"].to_numpy()
            for c in np.unique(kind):
                own, at = table[int(c)], np.flatnonzero(kind == c)
                row = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at], slot[at] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2]
            yield f.assign(sequence_id=sequence, slot=slot).drop(columns=["class", "rank"])

    rests = ranked.where("rest > 0").select("key", F.expr(f"full * {size}").alias("start"), F.col("rest").alias("length"), F.expr("crcs[int(full)]").alias("ids_crc32"), "doc_tokens", "class", "rank")
    rests = rests.mapInPandas(assigned, "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot")
    fulls = (
        ranked.where("full > 0")
        .select("key", "doc_tokens", "crcs", "sequence_full", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i"))
        .select("key", (F.col("i") * size).alias("start"), F.lit(size).cast("long").alias("length"), F.expr("crcs[int(i)]").alias("ids_crc32"), "doc_tokens", (F.col("sequence_full") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    return rests.unionByName(fulls).withColumnRenamed("key", key)
