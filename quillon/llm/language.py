"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's whole UTF-8 byte sequence in both directions without a break or reset, and labels every position with a
distribution over the languages; a document's probabilities are the mean over its positions that are letters (bytes A-Z, a-z and those of
characters past ASCII), each labelled with all of its context. Many texts of similar length run at once. Texts over `SPAN` bytes
are labelled span by span: one pass from the end leaves the backward state at each span's edge, then both directions go on from the
states before them, so the labels are those of the unbroken run in bounded memory.

Training is numpy back-propagation through time with Adam on windows of a bounded sample: of each language the `sample` labelled
rows that are first by hash of their id, `WINDOWS` substrings of `WINDOW` characters each. Strings of random letters are trained towards equal
shares, so that letters without a language get a low score.

Defined results: a null text or one without letters is `und` with score 0; a null lang or text teaches nothing; a null id counts
as empty text in the hold-out rule; without any labelled row all is `und`; repeated rows are predicted each; an empty table gives an
empty table. predict_language() drops other columns; with_language() keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import released, text_chunks

#: Bytes of a text that are labelled at once, those of all texts that run together, and positions whose inputs are laid out at once.
SPAN, RUN, LAID_OUT = 1 << 11, 1 << 19, 1 << 14
WINDOWS, WINDOW = 6, 160
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


_ONE, _HALF = np.array(1, np.float32), np.array(0.5, np.float32)


def softsign(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place: the candidate's bend, and with its range moved to 0..1 the gates'."""
    np.abs(x, out=room)
    room += _ONE
    x /= room


class Network:
    """Parameters of the update gate, the reset gate and the candidate, forward and backward: input rows of a byte (3, 2, 256, H), recurrent
    weights (3, 2, H, H), and the read-out of both directions (2, H, K). A new state is old + update * (softsign(input + reset * recurrent) - old)."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p = {"in": rng.normal(0, 0.7, (3, 2, 256, hidden)), "rec": rng.normal(0, hidden**-0.5, (3, 2, hidden, hidden)), "out": rng.normal(0, 0.5, (2, hidden, len(languages))), "bias": np.zeros(len(languages))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def scores(self, x: np.ndarray, lengths: np.ndarray, h: np.ndarray, sides: slice = slice(0, 2)) -> np.ndarray:
        """Scores (side, time, text, K) that each side (forward, backward) gives the bytes x (time, text), longest text first, by its own time; h (side, text, H)
        are the states to go on from and ends as the last ones. What is behind a text's end is not set."""
        hid, (longest, count) = self.hidden, x.shape
        both = range(2)[sides]
        gate_table, table = np.concatenate([*self.p["in"][:2]], axis=-1).reshape(512, 2 * hid), self.p["in"][2].reshape(512, hid)
        gate_rec, rec = np.concatenate([*self.p["rec"][:2]], axis=-1)[sides], self.p["rec"][2, sides] * np.float32(0.5)  # as the reset gate is kept doubled
        out = np.empty((len(both), longest, count, len(self.languages)), np.float32)
        gate_sums, sums, room = np.empty((len(both), count, 2 * hid), np.float32), np.empty_like(h), np.empty((len(both), count, 2 * hid), np.float32)
        at = 0
        while at < longest:
            n = int((lengths > at).sum())
            end = min(longest, at + max(1, LAID_OUT // n))
            sides_read = x[at:end, :n], x[np.maximum(lengths[:n] - 1 - np.arange(at, end)[:, None], 0), np.arange(n)]
            read = np.stack([sides_read[d].astype(np.int64) + 256 * d for d in both], axis=1)
            gates_in, candidates_in = gate_table.take(read, axis=0), table.take(read, axis=0)
            states = np.empty((len(both), end - at, n, hid), np.float32)
            for t, m in enumerate((lengths[:n] > np.arange(at, end)[:, None]).sum(axis=1).tolist()):
                old, g, s, tmp, small = h[:, :m], gates_in[t, :, :m], sums[:, :m], room[:, :m], room.reshape(len(both), -1, hid)[:, :m]
                g += np.matmul(old, gate_rec, out=gate_sums[:, :m])
                softsign(g, tmp)
                g += _ONE
                np.matmul(old, rec, out=s)
                s *= g[..., hid:]
                s += candidates_in[t, :, :m]
                softsign(s, small)
                s -= old
                s *= g[..., :hid]
                s *= _HALF
                old += s
                states[:, t, :m] = old
            for k, d in enumerate(both):
                out[k, at:end, :n] = states[k] @ self.p["out"][d]
            at = end
        return out

    def sums(self, x: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The sums of the languages' probabilities over each text's letters."""
        ahead, back = self.scores(x, lengths, h)
        z = np.take_along_axis(back, np.maximum(lengths - 1 - np.arange(len(x))[:, None], 0)[..., None], 0)
        z += ahead
        z += self.p["bias"]
        weight = (np.arange(len(x))[:, None] < lengths) & _LETTERS[x]
        z[~weight] = 0
        np.exp(np.clip(z, -80, 80, out=z), out=z)
        share = weight / z.sum(axis=2)
        return np.einsum("tnk,tn->nk", z, share, dtype=np.float64)

    def pooled(self, read: Callable[[int, int, int], np.ndarray], lengths: np.ndarray, span: int = SPAN) -> np.ndarray:
        """sums() of whole texts, longest first, span by span with the states carried over the edges; read(n, begin, end) gives the bytes (time, text)
        of the first n texts between two places."""
        edges = range(0, int(lengths[0]), span)
        count = lambda at: int((lengths > at).sum())
        h, behind = np.zeros((2, len(lengths), self.hidden), np.float32), {}
        for at in reversed(edges):
            n = count(at)
            behind[at] = h[1, :n].copy()
            if at:
                self.scores(read(n, at, at + span), np.minimum(lengths[:n] - at, span), h[1:, :n], slice(1, 2))
        h[:] = 0
        total = np.zeros((len(lengths), len(self.languages)))
        for at in edges:
            n = count(at)
            h[1, :n] = behind[at]
            total[:n] += self.sums(read(n, at, at + span), np.minimum(lengths[:n] - at, span), h[:, :n])
        return total

    def gradients(self, x: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions of x (time, text), longest first, towards the texts' distributions, and its gradients, by back-propagation through time."""
        hid, rec = self.hidden, self.p["rec"]
        (longest, count), real = x.shape, np.arange(len(x))[:, None] < lengths
        behind = np.maximum(lengths - 1 - np.arange(longest)[:, None], 0)
        read = np.stack([x, np.take_along_axis(x, behind, 0) + 256], axis=1)
        inputs = [t.take(read, axis=0) for t in self.p["in"].reshape(3, 512, hid)]
        h, out, trace = np.zeros((2, count, hid), rec.dtype), np.zeros((longest, 2, count, hid), rec.dtype), []
        room = np.empty_like(h)
        for t, n in enumerate(real.sum(axis=1).tolist()):
            old, tmp = h[:, :n].copy(), room[:, :n]
            z, r, m = inputs[0][t, :, :n] + old @ rec[0], inputs[1][t, :, :n] + old @ rec[1], old @ rec[2]
            softsign(z, tmp)
            softsign(r, tmp)
            c = inputs[2][t, :, :n] + (r + 1) / 2 * m
            softsign(c, tmp)
            h[:, :n] = out[t, :, :n] = old + (z + 1) / 2 * (c - old)
            trace.append((old, m, z, r, c))
        turned = np.take_along_axis(out[:, 1], behind[..., None], 0)
        z = softmax(out[:, 0] @ self.p["out"][0] + turned @ self.p["out"][1] + self.p["bias"])
        total = real.sum()
        loss = float(-((np.log(z + 1e-9) * target).sum(axis=2) * real).sum() / total)
        z = ((z - target) * (real[..., None] / total)).astype(rec.dtype)
        g = {"out": np.stack([np.tensordot(s, z, ((0, 1), (0, 1))) for s in (out[:, 0], turned)]), "bias": z.sum(axis=(0, 1)), "rec": np.zeros_like(rec)}
        up = np.stack([z @ self.p["out"][0].T, np.take_along_axis(z @ self.p["out"][1].T, behind[..., None], 0)], axis=1)
        down, carry = np.zeros((3, *read.shape, hid), rec.dtype), np.zeros_like(h)
        for t in range(longest - 1, -1, -1):
            old, m, z, r, c = trace[t]
            n = old.shape[1]
            dh = up[t, :, :n] + carry[:, :n]
            dc = dh * (z + 1) / 2 * (1 - np.abs(c)) ** 2
            dz = dh * (c - old) * (1 - np.abs(z)) ** 2 / 2
            dr = dc * m * (1 - np.abs(r)) ** 2 / 2
            sent = dz, dr, dc * (r + 1) / 2
            carry[:, :n] = dh * (1 - z) / 2
            for k, d in enumerate(sent):
                g["rec"][k] += old.swapaxes(1, 2) @ d
                carry[:, :n] += d @ rec[k].swapaxes(1, 2)
            down[0, t, :, :n], down[1, t, :, :n], down[2, t, :, :n] = dz, dr, dc
        order = np.argsort(read, axis=None, kind="stable")
        byte, first = np.unique(read.ravel()[order], return_index=True)
        g["in"] = np.zeros((3, 512, hid), rec.dtype)
        g["in"][:, byte] = np.add.reduceat(down.reshape(3, -1, hid)[:, order], first, axis=1)
        g["in"] = g["in"].reshape(self.p["in"].shape)
        return loss, g


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[str, str]], hidden: int = 8, steps: int = 350, batch: int = 64, noise: float = 0.1, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network fitted to (text, language) pairs: windows of the texts, languages in equal shares, and a share of random letters."""
    texts: dict[str, list[np.ndarray]] = {}
    for text, language in samples:
        if text:
            texts.setdefault(language, []).append(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
    languages = sorted(texts)
    if not languages:
        return None
    net, rng = Network(languages, hidden, seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        chosen, longest = [], int(rng.integers(24, 128))
        for k in range(batch):
            own = texts[languages[k % len(languages)]]
            text = own[rng.integers(len(own))]
            at = int(rng.integers(max(1, len(text) - longest + 1)))
            chosen.append((text[at : at + longest], np.eye(len(languages))[k % len(languages)]))
        for _ in range(round(noise * batch)):
            letters = rng.integers(97, 123, longest) - 32 * (rng.random() < 0.3)
            letters[rng.random(longest) < rng.choice([0.0, 0.15])] = 32
            chosen.append((letters, np.full(len(languages), 1 / len(languages))))
        chosen.sort(key=lambda c: -len(c[0]))
        lengths = np.array([len(c[0]) for c in chosen])
        x = np.zeros((lengths[0], len(chosen)), np.int32)
        for k, (text, _) in enumerate(chosen):
            x[: len(text), k] = text
        _, g = net.gradients(x, lengths, np.array([c[1] for c in chosen], np.float32))
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        for k, v in net.p.items():
            m, s = moments[k]
            m += 0.1 * (g[k] * min(1, 1 / (norm + 1e-9)) - m)
            s += 0.01 * ((g[k] * min(1, 1 / (norm + 1e-9))) ** 2 - s)
            v -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def lettered(text: np.ndarray) -> bool:
    """Whether a text's bytes hold a letter of any script."""
    return bool((_LETTERS[text] & (text < 128)).any()) or bool((text > 127).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8"))


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray, span: int = SPAN, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(mean probabilities of each row, whether it has a letter); rows of similar length run together."""
    sizes = np.diff(offsets)
    total, has = np.zeros((len(sizes), len(net.languages))), np.array([lettered(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], bool)
    todo = np.flatnonzero(has)
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    while len(todo):
        own = todo[: max(1, run // min(int(sizes[todo[0]]), span))]
        total[own] = net.pooled(lambda n, begin, end: data[np.minimum(offsets[own[:n]] + np.arange(begin, min(end, sizes[own[0]]))[:, None], offsets[own[:n] + 1] - 1)], sizes[own], span)
        todo = todo[len(own) :]
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30), has


def held_out(key: str, part: int) -> Column:
    """Whether crc32 of the id as text is divisible by `part`."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % part == 0


def labelled_sample(documents: DataFrame, sample: int, part: int, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(window of a text, lang) of at most `sample` rows of each language outside the held-out part, the first by hash of the id."""
    rows = documents.where(~held_out(key, part) & (F.length(text) > 0) & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    first = rows.select("l", "k").withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))).where(F.col("r") <= sample)
    chosen = rows.join(F.broadcast(first.select("l", "k").distinct()), ["l", "k"], "left_semi")
    room = F.greatest(F.length("t") - WINDOW, F.lit(0)) + 1
    windows = F.array_distinct(F.array(*(F.substring("t", (F.pmod(F.xxhash64("k", F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(WINDOWS))))
    found = chosen.groupBy("l", "k").agg(F.min(F.struct("t")).alias("s")).select("l", "k", F.col("s.t").alias("t")).select("l", "k", F.explode(windows).alias("w"))
    return [(r["w"], r["l"]) for r in found.orderBy("l", "k", "w").collect()]


def _told(documents: DataFrame, sample: int, part: int, key: str, text: str, lang: str) -> Column:
    """The column (lang_pred, score) of a text: Python sees the text alone."""
    net = train(labelled_sample(documents, sample, part, key, text, lang)) if lang in documents.columns else None

    def predicted(texts: pa.Array) -> pa.Array:
        released()
        best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for row, data, offsets in text_chunks(texts, 1 << 26) if net else ():
            mean, has = probabilities(net, data, offsets)
            at = row + np.flatnonzero(has)
            most = mean.argmax(axis=1)
            best[at] = np.array(net.languages, object)[most[has]]
            score[at] = np.clip(mean[has, most[has]], 0, 1)
        released()
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score)], ["lang_pred", "score"])

    # Not deterministic for the optimiser alone: so it isn't run once for a filter and once more for the columns.
    return F.arrow_udf(predicted, "lang_pred string, score double").asNondeterministic()(F.col(text))


def with_language(documents: DataFrame, name: str, sample: int = 200, part: int = 5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """documents with a struct column `name` (lang_pred, score); its name must be new."""
    if name in documents.columns:
        raise ValueError(f"{name} is a column already")
    return documents.withColumn(name, _told(documents, sample, part, key, text, lang))


def predict_language(documents: DataFrame, sample: int = 200, part: int = 5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred and score of each row; no shuffle besides the sample's choice."""
    told = documents.select(F.col(key).cast("long").alias(key), held_out(key, part).alias("held_out"), _told(documents, sample, part, key, text, lang).alias("told"))
    return told.select(key, "held_out", "told.lang_pred", "told.score")
