"""Alignment of two tokenizers over the same texts, and which of their ids belong together.

Inside mapInPandas each text is encoded by both, and the two rising lists of cumulative token ends are merged: where an end of one
is an end of the other, a group closes and the two tokens that end there are linked. Ends count bytes along a run of texts, so one
merge serves the run. A document sends each of its linked id pairs once with its number; Spark sums the pairs over the corpus,
finds the largest count of each id of the second tokenizer, and joins both back to the documents' links.

Pair counts are bounded by the product of the vocabularies and in practice far smaller; they are broadcast only up to a checked
number of rows, beyond it the join shuffles and adaptive execution splits hot pairs.

Defined results: a text that is null, empty, or not given back byte for byte by both tokenizers has no tokens, no groups and no
links; repeated rows count each; other columns are dropped, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .packing import Encoder
from .runtime import bounded, kept, stored, text_chunks

SCHEMA = "key string, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


class Strings:
    """Byte strings by id, gathered by numpy."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def byte_level_strings(library) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    vocabulary = library.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(pretokens._BYTE_OF[c] for c in piece)
    return out


def piece_strings(model) -> list[bytes]:
    """The bytes of each id of a sentence-piece vocabulary."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        self.encoder = Encoder(byte_level)
        self.encoder.library.encode_special_tokens = True  # their strings inside texts are plain text
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a, self.b = Strings(byte_level_strings(self.encoder.library)), Strings(piece_strings(self.model))
        self.decimal = Strings([b"%d," % i for i in range(max(len(self.a.size), len(self.b.size)))])

    @staticmethod
    def lossless(strings: Strings, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which rows the ids give back byte for byte."""
        ends = np.concatenate([[0], np.cumsum(strings.size[ids])])
        ok = np.diff(ends[rows]) == np.diff(offsets)
        own, given = data[np.repeat(ok, np.diff(offsets))], strings.joined(ids[np.repeat(ok, np.diff(rows))])
        wrong = np.concatenate([[0], np.cumsum(own != given)])
        at = np.concatenate([[0], np.cumsum(np.diff(offsets)[ok])])
        ok[ok] = wrong[at[1:]] == wrong[at[:-1]]
        return ok

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(rows with tokens, ids of both, first id of each such row and the end, twice)."""
        full = np.flatnonzero(np.diff(offsets) > 0)
        spaced = np.insert(data, offsets[full], 32)
        spans = np.concatenate([[0], np.cumsum(np.diff(offsets)[full] + 1)])
        a, rows_a = self.encoder.ids(spaced, spans)
        lists = self.model.encode([data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8") for r in full], num_threads=1) if len(full) else []
        rows_b = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        b = np.fromiter((i for x in lists for i in x), np.int64, rows_b[-1])
        ok = self.lossless(self.a, a, rows_a, spaced, spans) & self.lossless(self.b, b, rows_b, spaced, spans)
        a, b = a[np.repeat(ok, np.diff(rows_a))], b[np.repeat(ok, np.diff(rows_b))]
        return full[ok], a, b, np.concatenate([[0], np.cumsum(np.diff(rows_a)[ok])]), np.concatenate([[0], np.cumsum(np.diff(rows_b)[ok])])

    def aligned(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
        """The columns of SCHEMA but the key, for a run of texts."""
        n = len(offsets) - 1
        where, a, b, rows_a, rows_b = self.encoded(data, offsets)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        other = np.searchsorted(end_b, end_a)  # the merge: both lists rise
        shared = np.flatnonzero(end_b[np.minimum(other, max(len(end_b) - 1, 0))] == end_a) if len(b) else np.zeros(0, np.int64)
        cuts = end_a[shared]
        counts = np.diff(np.searchsorted(shared, rows_a))
        out = {"n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_groups": np.zeros(n, np.int64)}
        out["n_a"][where], out["n_b"][where], out["n_groups"][where] = np.diff(rows_a), np.diff(rows_b), counts
        return out | self._links(n, where, a[shared] << 32 | b[other[shared]], counts) | {"groups_sha256": self._digests(n, where, a, b, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), rows_a, rows_b)}

    @staticmethod
    def _links(n: int, where: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> dict[str, list]:
        """Each row's distinct pairs and how often it links them."""
        row = np.repeat(np.arange(len(where)), counts)
        order = np.lexsort((pairs, row))
        pairs, row = pairs[order], row[order]
        edge = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (row[1:] != row[:-1])])) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.append(edge, len(pairs)))
        at = np.searchsorted(row[edge], np.arange(len(where) + 1))
        none = np.zeros(0, np.int64)
        own_pairs, own_times = [none] * n, [none] * n
        for k, r in enumerate(where.tolist()):
            own_pairs[r], own_times[r] = pairs[edge[at[k] : at[k + 1]]], times[at[k] : at[k + 1]]
        return {"pairs": own_pairs, "times": own_times}

    def _digests(self, n, where, a, b, group_a, group_b, rows_a, rows_b) -> list[str]:
        """SHA-256 of each row's groups as text: ids of a, "|", ids of b, ";" between groups."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([a, b])[order]
        text = self.decimal.joined(ids).copy()
        ends = np.cumsum(self.decimal.size[ids])
        turn = np.flatnonzero(side[1:] != side[:-1])
        text[ends[turn] - 1] = np.where(side[turn] % 2 == 0, ord("|"), ord(";"))
        at = np.concatenate([[0], ends[(rows_a + rows_b)[1:] - 1]]) if len(where) else [0]
        out, data = [""] * n, text.tobytes()
        for k, r in enumerate(where.tolist()):
            out[r] = hashlib.sha256(data[at[k] : at[k + 1] - 1]).hexdigest()
        return out


def align(documents: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SCHEMA of each row (pairs hold the first id in the upper 32 bits) and `row`, a number of its own; stored, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = kept(("align", byte_level, pieces), lambda: Aligner(byte_level, pieces))
        for frame in frames:
            for row, data, offsets in text_chunks(pa.array(frame["text"], pa.large_string(), from_pandas=True)):
                yield pd.DataFrame({"key": frame["key"].iloc[row : row + len(offsets) - 1].to_numpy()} | aligner.aligned(data, offsets))[[c.split()[0] for c in SCHEMA.split(", ")]]

    rows = documents.select(F.col(key).cast("long").cast("string").alias("key"), F.col(text).alias("text"))  # pandas has no nullable longs here
    out = rows.mapInPandas(run, SCHEMA).withColumn("key", F.col("key").cast("long"))
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links over the corpus) and best (no pair of its second id has a larger count); stored."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = stored(links.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return stored(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-ranks")


def alignment_digest(documents: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    aligned = align(documents, byte_level, pieces, key, text)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    back = links.join(bounded(pair_counts(aligned)), "pair").groupBy("row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = aligned.drop("pairs", "times").join(back, "row", "left")
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256")
