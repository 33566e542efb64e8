"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources share a budget of words by weight; a target stops at `repeats` times its source's words and the excess is shared again.
A source's documents, in an order drawn by hash, form one line of words, cut into blocks of equal length. A target of more words
than the source has takes every block once or more and part of a further copy; each copy has its own permutation of the blocks
(a Feistel network on their numbers, so no list of blocks exists), and the last block taken is cut so that the words are exact.

The drawn blocks go to output shards of equal numbers of blocks: a node of a binary tree over the shards splits its quotas, one for
each source, into those of its two halves by one multivariate hypergeometric draw, whose generator is seeded by the node. A source's
draws stand in a row, each shard owns a run of them, so shards are disjoint and every quota is met exactly. The tree is a function
of seed and quotas: a task computes the nodes that it needs, nothing of it is shipped, and a rerun agrees.
Inside a shard, pieces are ordered by a hash.

Places on a source's line come from sums within hash buckets, shifted by the sums of earlier buckets, over distinct
(document, text) pairs with their number of copies: a source or a repeated row with a third of all rows meets no single task.

Defined results: null or empty text has 0 words and is never taken; a null source is a source of its own, the last; repeated rows
are taken each; an empty table gives an empty table; other columns are dropped, so none can clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .runtime import stored, text_chunks

#: Words of a block while there are fewer than MOST_BLOCKS; beyond that blocks grow (the hypergeometric sampler takes under 1e9).
BLOCK_WORDS, MOST_BLOCKS = 512, 1 << 28
#: Blocks of an output shard (about a million words).
SHARD_BLOCKS = 2048
WEIGHTS = (3, 1, 2)
PIECES = "array<struct<copy:int,start:long,words:long,shard:long,place:long>>"


def targets(sizes: list[int], weights: list[float], budget: float, repeats: float) -> list[float]:
    """Words for each source: the budget by weight, no more than repeats * size, the excess shared again until none is above."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: budget * weights[i] / total for i in open_}
        full = [i for i in open_ if share[i] > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            budget -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 drawn by `key`: four Feistel rounds on the next even number of bits, walked until inside."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, u = hashing.U((1 << half) - 1), hashing.U
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> u(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (hashing.mix(right + u((key * 4 + r + 1) & (1 << 64) - 1)) & mask)
        out[todo] = left << u(half) | right
        todo = todo[out[todo] >= u(n)]
    return out.astype(np.int64)


class Plan:
    """Quotas of all sources and the tree that deals them to shards."""

    def __init__(self, sizes: list[int], wanted: list[int], seed: int, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS):
        self.sizes, self.wanted, self.seed = sizes, wanted, seed
        self.block = max(block_words, sum(wanted) // MOST_BLOCKS + 1)
        self.blocks = [-(-s // self.block) for s in sizes]
        self.quotas = np.array([self._quota(i) for i in range(len(sizes))], np.int64)
        self.draws = int(self.quotas.sum())
        self.shards = max(1, -(-self.draws // shard_blocks))
        self._node = functools.lru_cache(1 << 16)(self._split)

    def _key(self, source: int, copy: int) -> int:
        return int(hashing.mix(np.array([self.seed << 40 ^ source << 8 ^ copy], np.uint64))[0])

    def _short(self, source: int, copy: int) -> int:
        """The place that the source's last, shorter block has in the copy's order."""
        n = self.blocks[source]
        return int(permuted(np.array([n - 1]), n, self._key(source, copy))[0])

    def before(self, source: int, copy: int, place: np.ndarray) -> np.ndarray:
        """Words of the copy's blocks in front of a place."""
        lack = self.blocks[source] * self.block - self.sizes[source]
        return place * self.block - np.where(place > self._short(source, copy), lack, 0)

    def _quota(self, source: int) -> int:
        size, wanted, n = self.sizes[source], self.wanted[source], self.blocks[source]
        if not size:
            return 0
        whole, rest = divmod(wanted, size)
        if not rest:
            return whole * n
        places = np.array([rest // self.block, rest // self.block + 1, rest // self.block + 2])
        return whole * n + int(places[np.flatnonzero(self.before(source, whole, places) >= rest)[0]])

    def _first(self, shard: int) -> int:
        """The draws of all shards in front of one."""
        return self.draws * shard // self.shards

    def _split(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Quotas of the node over shards low..high-1 and of its left half."""
        if (low, high) == (0, self.shards):
            own = self.quotas
        else:
            above, side = self._parent(low, high)
            whole, left = self._node(*above)
            own = left if side == 0 else whole - left
        middle = (low + high) // 2
        draw = np.random.default_rng([self.seed, low, high]).multivariate_hypergeometric(own, self._first(middle) - self._first(low), method="marginals") if high - low > 1 else own
        return own, draw

    def _parent(self, low: int, high: int) -> tuple[tuple[int, int], int]:
        a, b = 0, self.shards
        while True:
            middle = (a + b) // 2
            child = (a, middle) if low < middle else (middle, b)
            if child == (low, high):
                return (a, b), int(low >= middle)
            a, b = child

    def shard_of(self, source: int, draw: np.ndarray) -> np.ndarray:
        """The shard of each of a source's draws: down the tree, left while its place is below the left half's quota."""
        out = np.zeros(len(draw), np.int64)
        stack = [(0, self.shards, np.arange(len(draw)), draw.astype(np.int64))]
        while stack:
            low, high, at, place = stack.pop()
            if high - low == 1:
                out[at] = low
                continue
            quota, middle = int(self._node(low, high)[1][source]), (low + high) // 2
            left = place < quota
            if left.any():
                stack.append((low, middle, at[left], place[left]))
            if not left.all():
                stack.append((middle, high, at[~left], place[~left] - quota))
        return out

    def pieces(self, source: int, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, copy, start in the document, words, shard, draw) of what is taken of the documents at first..first+size of the line."""
        n, wanted, total = self.blocks[source], self.wanted[source], self.sizes[source]
        low, high = first // self.block, -(-(first + size) // self.block)
        count = np.where(size > 0, high - low, 0)
        row = np.repeat(np.arange(len(first)), count)
        block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[row]
        begin = np.maximum(block * self.block, first[row])
        end = np.minimum((block + 1) * self.block, (first + size)[row])
        found = []
        for copy in range(-(-wanted // total) if total else 0):
            place = permuted(block, n, self._key(source, copy))
            room = min(total, wanted - copy * total) - self.before(source, copy, place)  # words that the copy may still take at the block's start
            stop = np.minimum(end, block * self.block + np.maximum(room, 0))
            on = np.flatnonzero(stop > begin)
            draw = copy * n + place[on]
            found.append((row[on], np.full(len(on), copy), begin[on] - first[row[on]], (stop - begin)[on], self.shard_of(source, draw), draw))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 6


def sized(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source, identity of the text and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for row, data, offsets in text_chunks(batch.column(3)):
                size[row : row + len(offsets) - 1] = np.diff(hashing.words(data, offsets)[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size)], ["key", "source", "same", "size"])

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, source string, same long, size long")


def drawn(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 7, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Of each row: key, source, same (the text's hash), size, source_size, target and pieces (copy, start, words, shard, place)."""
    rows = stored(sized(documents, key, text, source).groupBy("key", "source", "same", "size").agg(F.count("*").alias("copies")), "sized")
    per_source = {r["source"]: int(r["words"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).collect()}  # a row for each source
    names = sorted((s for s in per_source if s is not None)) + [None] * (None in per_source)
    sizes = [per_source[s] for s in names]
    target = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], share * sum(sizes), repeats)
    wanted = [min(round(t), repeats * s) for t, s in zip(target, sizes)]

    buckets = max(16, rows.count() // 20_000)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", "same"), F.lit(buckets)))
    order = Window.partitionBy("bucket", "source").orderBy(F.xxhash64(F.lit(seed + 1), "key", "same"), "key", "same").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.col("source").alias("of"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
    placed = inside.join(sums.withColumnRenamed("bucket", "b"), (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("of"))).withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.select("key", "source", "same", "size", (F.col("base") + F.col("inside") + F.col("copy_no") * F.col("size")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, number = Plan(sizes, wanted, seed, block_words, shard_blocks), {s: i for i, s in enumerate(names)}
        for batch in batches:
            of = np.array([number[s] for s in batch.column(1).to_pylist()], np.int64)
            size, first = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            parts = []
            for i in np.unique(of):
                at = np.flatnonzero(of == i)
                row, *rest = plan.pieces(int(i), first[at], size[at])
                parts.append((at[row], *rest))
            row, copy, start, words, shard, draw = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 6
            turn = np.lexsort((start, copy, row))
            place = hashing.mix(draw.astype(np.uint64) * hashing.U(len(names) + 1) + of[row].astype(np.uint64) + hashing.U(seed << 32)).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(of)))])
            fields = [pa.array(copy[turn], pa.int32()), *(pa.array(x[turn]) for x in (start, words, shard, place))]
            struct = pa.StructArray.from_arrays(fields, ["copy", "start", "words", "shard", "place"])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([sizes[i] for i in of], pa.int64()), pa.array([target[i] for i in of], pa.float64()), lists], ["key", "source", "same", "size", "source_size", "target", "pieces"])

    out = placed.mapInArrow(run, f"key long, source string, same long, size long, source_size long, target double, pieces {PIECES}")
    return out.withColumnRenamed("key", key)


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed pieces: shard, position (from 0, shuffled inside the shard), key, source, copy, start, words and the text of these words."""
    pieces = drawn(documents, key, text, source, **how).select(F.col(key).alias("key"), "source", "same", F.explode("pieces").alias("p")).select("key", "source", "same", "p.*")
    texts = documents.select(F.col(key).cast("long").alias("of_key"), F.col(source).cast("string").alias("of"), F.xxhash64(text).alias("text_of"), F.col(text).alias("whole")).dropDuplicates(["of_key", "of", "text_of"])
    joined = pieces.join(texts, F.col("key").eqNullSafe(F.col("of_key")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("same") == F.col("text_of")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            starts, counts = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            for row, data, offsets in text_chunks(batch.column(7)):
                begin, end, of = hashing.words(data, offsets)
                for k in range(len(offsets) - 1):
                    a, n = int(of[k] + starts[row + k]), int(counts[row + k])
                    out.append(data[begin[a] : end[a + n - 1]].tobytes().decode("utf-8"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(out, pa.string())], ["shard", "place", "key", "source", "copy", "start", "words", "text"])

    texts = joined.select("shard", "place", "key", "source", "copy", "start", "words", "whole").mapInArrow(cut, "shard long, place long, key long, source string, copy int, start long, words long, text string")
    inside = Window.partitionBy("shard").orderBy("place", "source", "key", "copy", "start")  # a shard is some SHARD_BLOCKS blocks
    return texts.withColumn("position", (F.row_number().over(inside) - 1).cast("long")).drop("place").withColumnRenamed("key", key)


def mix_digest(documents: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """key, size, source_size, target and taken (words of all pieces) of each row."""
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return drawn(documents, key, **how).select(key, "size", "source_size", "target", taken.alias("taken"))
