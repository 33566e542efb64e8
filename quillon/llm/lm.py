"""Language-model scores by a weighted backoff automaton over word n-grams.

The root state holds the smoothed unigrams of the whole training part. Each training word is a state for itself as context, with an arc
for every word seen behind it: its count after `prior` pseudo-counts, plus its share of the mass left (the pseudo-counts), which is dealt
as the root deals; a failure arc leads back to the root at the weight of the mass left. A `state_share` above 0 keeps only words with that
relative frequency as states, and only arcs between them. N-grams end at two words.
A text is one left-to-right traversal: each token takes its state's arc, or the failure arc and the root's, and sets the next state.

Counting and look-up are exact and spread: texts become runs of local word numbers once (written to the shared folder); each run asks
hash buckets for the training counts of its distinct words and of its distinct word pairs and gets them back, so neither vocabulary nor
arcs are broadcast, and both grow with the input. Words are compared by 64-bit hash, pairs by the bucket and 48 bits of theirs.

Defined results: null or empty text is the end token alone; a null id counts as empty text in the hold-out rule; repeated rows count and are scored each;
without training rows all counts are 0; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, routed
from .language import held_out
from .runtime import released, stored, text_chunks

END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Tokens of a run.
RUN_TOKENS = 1 << 20
_RUN_SCHEMA = "run string, keys array<bigint>, held array<boolean>, sizes array<bigint>, tokens binary, words binary, train binary"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all rows' words, each row closed by END; tokens of each row)."""
    hashes, rows = hashing.word_hashes(data, offsets)
    sizes = np.diff(rows) + 1
    out = np.empty(len(hashes) + len(sizes), np.uint64)
    ends = np.cumsum(sizes) - 1
    out[ends] = END
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes
    return out, sizes


def _planes(flat: np.ndarray) -> bytes:
    """Token numbers with their bytes in planes: the upper ones, mostly 0, compress."""
    return flat.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _flat(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _runs(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        keys, held, sizes, parts = [], [], [], []

        def shipped() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            words, local = np.unique(flat, return_inverse=True)
            training = np.repeat(~np.array(held, bool), sizes)
            train = np.bincount(local[training], minlength=len(words)).astype("<u4")
            row = [uuid.uuid4().hex], [keys], [held], [sizes], [_planes(local)], [words.astype("<u8").tobytes()], [train.tobytes()]
            kinds = pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], [c.split()[0] for c in _RUN_SCHEMA.split(", ")])

        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(2)):
                flat, count = tokens(data, offsets)
                keys += batch.column(0).slice(row, len(count)).to_pylist()
                held += batch.column(1).slice(row, len(count)).to_pylist()
                sizes += count.tolist()
                parts.append(flat)
                if sum(map(len, parts)) >= RUN_TOKENS:
                    yield shipped()
                    keys, held, sizes, parts = [], [], [], []
        if parts:
            yield shipped()

    return rows.mapInArrow(run, _RUN_SCHEMA)


def _dealt(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of a run's words by bucket, their buckets in that order)."""
    bucket = (words % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _counted(runs: DataFrame, buckets: int, share: float) -> DataFrame:
    """For each run and bucket the training counts of the run's words there; for each bucket its sums and its frequent words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, words, train in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, train = np.frombuffer(words, "<u8"), np.frombuffer(train, "<u4")
                order, bucket = _dealt(words, buckets)
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                spans = [*zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([name] * len(spans)), pa.array([words[order[a:b]].tobytes() for a, b in spans], pa.binary()), pa.array([train[order[a:b]].tobytes() for a, b in spans], pa.binary())], ["bucket", "run", "words", "train"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [np.frombuffer(w, "<u8") for w in frame["words"]]
        words, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.zeros(len(words), np.int64)
        np.add.at(count, inverse, np.concatenate([np.frombuffer(t, "<u4") for t in frame["train"]]).astype(np.int64))
        cut = np.cumsum([len(w) for w in asked])[:-1]
        given = pd.DataFrame({"bucket": frame["bucket"], "run": frame["run"], "counts": [c.tobytes() for c in np.split(count[inverse], cut)], "tokens": 0, "types": 0})
        often = np.flatnonzero((count > 0) & (count >= share * count.sum())) if share else np.zeros(0, np.int64)
        total = pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "run": [None], "counts": [None], "tokens": [count.sum()], "types": [(count > 0).sum()]})
        out = pd.concat([given, total])
        out["frequent"] = [[] for _ in range(len(given))] + [[{"word": w, "n": n} for w, n in zip(words[often].view(np.int64).tolist(), count[often].tolist())]]
        return out[["bucket", "run", "counts", "tokens", "types", "frequent"]]

    asked = runs.select("run", "words", "train").mapInArrow(ask, "bucket long, run string, words binary, train binary")
    return asked.groupBy("bucket").applyInPandas(answer, "bucket long, run string, counts binary, tokens long, types long, frequent array<struct<word: bigint, n: bigint>>")


def _pairs(flat: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in a run with a token of the same text behind them, the number of each one's word pair, the pairs' hashes)."""
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(sizes) - 1] = False
    at = np.flatnonzero(inner)
    codes, pair = np.unique(flat[at].astype(np.uint64) * np.uint64(len(words)) + flat[at + 1], return_inverse=True)
    first, second = words[codes // np.uint64(len(words))], words[codes % np.uint64(len(words))]
    return at, pair, hashing.mix(hashing.mix(first) + second)


def _pairs_dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of a run's pairs by bucket and hash, their buckets in that order)."""
    order = np.argsort(h)
    by, bucket = _dealt(h[order], buckets)
    return order[by], bucket


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as their largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


def _pairs_counted(runs: DataFrame, buckets: int) -> DataFrame:
    """For each run and bucket the training counts of the run's word pairs there, in the order of _pairs_dealt."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, held, sizes, flat, words = (batch.column(k)[i].as_py() for k in range(5))
                sizes = np.array(sizes)
                at, pair, h = _pairs(_flat(flat), sizes, np.frombuffer(words, "<u8"))
                train = np.bincount(pair[np.repeat(~np.array(held, bool), sizes)[at]], minlength=len(h))
                order, bucket = _pairs_dealt(h, buckets)
                if not len(h):
                    continue
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                spans = [*zip(edges[:-1].tolist(), edges[1:].tolist())]
                # The upper six bytes, one plane each: those of sorted hashes compress.
                planes, train = h[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:], train[order]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([name] * len(spans)), pa.array([planes[a:b].T.tobytes() for a, b in spans], pa.binary()), pa.array([_packed(train[a:b]) for a, b in spans], pa.binary())], ["bucket", "run", "pairs", "train"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(p) // 6 for p in frame["pairs"]]
        asked = np.zeros((sum(sizes), 8), np.uint8)
        asked[:, 2:] = np.concatenate([np.frombuffer(p, np.uint8).reshape(6, -1).T for p in frame["pairs"]])
        pairs, inverse = np.unique(asked.view("<u8").ravel(), return_inverse=True)
        train = np.concatenate([_unpacked(t, n) for t, n in zip(frame["train"], sizes)])
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, inverse, train)
        given = np.split(count[inverse], np.cumsum(sizes)[:-1])
        return pd.DataFrame({"bucket": frame["bucket"], "run": frame["run"], "counts": [_packed(c) for c in given]})

    asked = runs.select("run", "held", "sizes", "tokens", "words").mapInArrow(ask, "bucket long, run string, pairs binary, train binary")
    return asked.groupBy("bucket").applyInPandas(answer, "bucket long, run string, counts binary")


def _kept(runs: DataFrame, states: np.ndarray) -> np.ndarray:
    """The training count of all arcs between states by the first one's state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(len(states), np.int64)
        for batch in batches:
            for held, sizes, flat, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                state = _state_of(np.frombuffer(words, "<u8"), states)[_flat(flat)]
                good = np.repeat(~np.array(held, bool), sizes)
                good[np.cumsum(sizes) - 1] = False
                at = np.flatnonzero(good & (state >= 0))
                kept += np.bincount(state[at[state[at + 1] >= 0]], minlength=len(states))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(states))), pa.array(kept)], ["state", "n"])

    out = np.zeros(len(states), np.int64)
    for r in runs.select("held", "sizes", "tokens", "words").mapInArrow(run, "state long, n long").groupBy("state").agg(F.sum("n").alias("n")).collect():
        out[r["state"]] = r["n"]
    return out


def _state_of(words: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The state of each word, -1 for the root."""
    if not len(states):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(states, words), len(states) - 1)
    return np.where(states[at] == words, at, -1)


class Automaton:
    """Weights of a run's arcs from its counts; states (sorted word hashes) and the counts of their arcs, if not all words are states."""

    def __init__(self, total: int, types: int, prior: float, states: np.ndarray | None = None, kept: np.ndarray | None = None):
        self.total, self.types, self.prior, self.states, self.kept = total, types, prior, states, kept

    def traverse(self, flat: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, at: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base score, score, known tokens) of each text of a run; arcs has the training count of the pair at each place of at."""
        base = ((counts + 0.1) / (self.total + 0.1 * (self.types + 1)))[flat]
        begins = np.cumsum(sizes) - sizes
        after, left = counts, self.prior
        if self.states is not None:
            state = _state_of(words, self.states)
            # A word that is no state deals as the root does.
            after = np.where(state >= 0, counts, 0)
            left = self.prior + after - (np.append(self.kept, 0)[state])
            left, arcs = left[flat[at]], np.where((state[flat[at]] >= 0) & (state[flat[at + 1]] >= 0), arcs, 0)
        p = base.copy()
        p[at + 1] = (arcs + left * base[at + 1]) / (after[flat[at]] + self.prior)
        return np.add.reduceat(np.log10(base), begins), np.add.reduceat(np.log10(p), begins), np.add.reduceat((counts > 0)[flat].astype(np.int64), begins)


def score_texts(documents: DataFrame, part: int = 10, state_share: float = 0.0, prior: float = 200.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row."""
    rows = documents.select(F.col(key).cast("long").alias("key"), held_out(key, part).alias("held"), F.col(text).alias("text"))
    runs = stored(_runs(rows), "runs")
    asked = runs.agg(F.sum(F.octet_length("words") / 8).alias("n")).first()["n"] or 0
    buckets = max(12, int(asked // routed.PER_BUCKET))
    counted = stored(_counted(runs, buckets, state_share), "counted")
    sums = counted.where("run IS NULL").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    total, types = int(sums["tokens"] or 0), int(sums["types"] or 0)
    states = kept = None
    if state_share:
        frequent = counted.where("run IS NULL").select(F.explode("frequent").alias("f")).where(F.col("f.n") >= state_share * total).select("f.word").collect()
        states = np.sort(np.array([r["word"] for r in frequent], np.int64).view(np.uint64))
        kept = _kept(runs, states)
    automaton = Automaton(total, types, prior, states, kept)
    sums = runs.agg(F.sum(F.octet_length("tokens") / 4).alias("n"), F.count(F.lit(1)).alias("runs")).first()
    pair_buckets = max(12, int((sums["n"] or 0) // routed.PER_BUCKET))
    # Two parts a run, so that few runs meet in one task's batch.
    parts = max(12, 2 * sums["runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, held, sizes, flat, words, given, arcs_given = (c[i].as_py() for c in batch.columns)
                flat, words, sizes = _flat(flat), np.frombuffer(words, "<u8"), np.array(sizes)
                order, _ = _dealt(words, buckets)
                counts = np.empty(len(words), np.int64)
                counts[order] = np.concatenate([np.frombuffer(g["counts"], np.int64) for g in sorted(given, key=lambda g: g["bucket"])])
                at, pair, h = _pairs(flat, sizes, words)
                order, bucket = _pairs_dealt(h, pair_buckets)
                arcs, n = np.empty(len(h), np.int64), np.bincount(bucket, minlength=pair_buckets)
                arcs[order] = np.concatenate([np.zeros(0, np.int64), *(_unpacked(g["counts"], n[g["bucket"]]) for g in sorted(arcs_given or [], key=lambda g: g["bucket"]))])
                base, score, known = automaton.traverse(flat, sizes, words, counts, at, arcs[pair])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known), pa.array(np.full(len(sizes), total, np.int64)), pa.array(base), pa.array(score)], ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    gathered = lambda rows, name: rows.repartition(parts, "run").groupBy("run").agg(F.collect_list(F.struct("bucket", "counts")).alias(name))
    given, arcs_given = gathered(counted.where("run IS NOT NULL"), "given"), gathered(_pairs_counted(runs, pair_buckets), "arcs_given")
    joined = runs.repartition(parts, "run").join(given, "run").join(arcs_given, "run", "left").select("keys", "held", "sizes", "tokens", "words", "given", "arcs_given")
    out = joined.mapInArrow(run, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
