"""Token counts of whole texts by a public BPE vocabulary, with the whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone by the library; those that come out as one
token are proven whole tokens, and a pre-token equal to one counts 1 without merging. Other pre-tokens are
merged by the library, each distinct one once per worker (a bounded memory of results). Texts that the array
splitter may not take are encoded whole by the library, so every count is the library's.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; other columns are
dropped, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .runtime import kept, text_chunks


class Counter:
    """Counts by one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.whole = self.proven_whole()
        self.known = pretokens.Memory()

    def proven_whole(self) -> dict[int, int]:
        """Hashes of the pre-tokens that the library encodes as exactly one token."""
        texts = []
        for piece in self.library.get_vocab():
            if piece.endswith("</w>"):
                text = pretokens.unmapped(piece[: -len("</w>")])
                if text and all(ord(c) < 0x2100 and pretokens.CLASS[ord(c)] for c in text):
                    texts.append(text)
        sizes = np.array([len(t) for t in texts])
        rows = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        starts, ends = pretokens.split_words(codes, rows)
        one = np.isin(rows[:-1], starts[np.isin(starts, rows[:-1]) & (ends == rows[np.searchsorted(rows, starts, "right")])])
        hashes = pretokens.code_hashes(codes, rows[:-1], rows[1:])
        encoded = self.library.encode_batch(texts, add_special_tokens=False)
        return {int(h): 1 for h, alone, e in zip(hashes, one, encoded) if alone and len(e) == 1}

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        text = pretokens.Codes(data, offsets)
        codes = pretokens.LOWER_CODE[text.codes]
        starts, ends = pretokens.split_words(codes, text.rows)
        hashes = pretokens.code_hashes(codes, starts, ends)
        found, missing = self.known.find(hashes)
        if len(missing):
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            value = np.array([self.whole.get(h, 0) for h in new.tolist()], np.int64)
            for i in np.flatnonzero(value == 0):
                value[i] = len(self.library.model.tokenize(pretokens.mapped(pretokens.string(codes[starts[first[i]] : ends[first[i]]]))))
            found[missing] = value[inverse]
            self.known.put(new, value)
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(found, out=sums[1:])
        at = np.searchsorted(starts, text.rows, "left")
        out = sums[at[1:]] - sums[at[:-1]]
        odd = np.flatnonzero(~text.plain)
        if len(odd):
            whole = [data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8") for r in odd]
            out[odd] = [len(e) for e in self.library.encode_batch(whole, add_special_tokens=False)]
        return out


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("counts", vocabulary), lambda: Counter(vocabulary))
        for batch in batches:
            column = batch.column(1)
            size, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, data, offsets in text_chunks(column):
                at = slice(row, row + len(offsets) - 1)
                size[at], tokens[at] = np.diff(offsets), counter.counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
