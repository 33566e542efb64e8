"""An ensemble of masked autoencoders over many channels, trained by gradient sums over partitions.

Each step is one Spark job: a task holds a share of the times, hides a share of the channels of each time, and adds up the gradients
of the squared error on hidden channels alone; Spark sums them by column block. The driver holds parameters and their moments (inputs
times units, never channels squared) and broadcasts them in column blocks; as many members are trained at once as AT_ONCE allows.
What a time hides is a hash of seed, member, step, time and channel, so neither partitions nor lost executors change the model.

The network: inputs -> units (tanh) -> code -> units (tanh) -> inputs. A binary code takes the sign; its gradient passes where the
value before it lies within -1 and 1. Hidden inputs are 0 ("zero") or drawn from -2..2 ("uniform").
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters that are trained in one job (float32, with two moments and the gradient: 16 bytes each on the driver).
AT_ONCE = 8 << 20
#: Channels of a column block, and floats of inputs that a kernel takes at once.
BLOCK, CHUNK = 1024, 4 << 20
_U = np.uint64


@dataclass(frozen=True)
class Training:
    code: int = 8
    members: int = 2
    masked: float = 0.25
    steps: int = 60
    rate: float = 0.01
    binary: bool = False
    fill: str = "zero"
    seed: int = 0

    @property
    def units(self) -> int:
        return max(2 * self.code, 64)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def uniforms(t: np.ndarray, width: int, *salt: int) -> np.ndarray:
    """times x width numbers in 0..1, each a hash of its time, column and salt."""
    key = np.array([0x9E3779B97F4A7C15], np.uint64)
    for s in salt:
        key = _mix(key + _U(s))
    rows = _mix(t.astype(np.int64).view(np.uint64) + key)
    return (_mix(rows[:, None] + np.arange(1, width + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) >> _U(40)).astype(np.float32) / np.float32(1 << 24)


def first_parameters(inputs: int, training: Training, member: int) -> dict[str, np.ndarray]:
    """Uniform within one over the root of a layer's inputs."""
    rng, out = np.random.default_rng([training.seed, member]), {}
    for k, (a, b) in {"1": (inputs, training.units), "2": (training.units, training.code), "3": (training.code, training.units), "4": (training.units, inputs)}.items():
        out["w" + k], out["b" + k] = (rng.uniform(-1, 1, s).astype(np.float32) / np.float32(np.sqrt(a)) for s in ((a, b), b))
    return out


def _blocks(inputs: int, width: int) -> list[slice]:
    return [slice(i, min(i + BLOCK * width, inputs)) for i in range(0, inputs, BLOCK * width)]


def corrupted(x: np.ndarray, t: np.ndarray, width: int, training: Training, member: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs with hidden channels filled, which inputs are hidden)."""
    channels = x.shape[1] // width
    hidden = np.repeat(uniforms(t, channels, training.seed, member, step) < training.masked, width, axis=1)
    filled = np.float32(4) * uniforms(t, x.shape[1], training.seed, member, step, 1) - np.float32(2) if training.fill == "uniform" else np.float32(0)
    return np.where(hidden, filled, x), hidden


def encode(x: np.ndarray, p: dict[str, np.ndarray], binary: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, code before the sign, code)."""
    units = np.tanh(x @ p["w1"] + p["b1"])
    plain = units @ p["w2"] + p["b2"]
    return units, plain, np.where(plain >= 0, np.float32(1), np.float32(-1)) if binary else plain


def gradients(x: np.ndarray, t: np.ndarray, width: int, p: dict[str, np.ndarray], training: Training, member: int, step: int) -> tuple[dict[str, np.ndarray], float, int]:
    """(sums of the gradients, squared error, hidden inputs) of some times."""
    seen, hidden = corrupted(x, t, width, training, member, step)
    units, plain, code = encode(seen, p, training.binary)
    late = np.tanh(code @ p["w3"] + p["b3"])
    off = np.where(hidden, late @ p["w4"] + p["b4"] - x, np.float32(0))
    out = {"w4": late.T @ (2 * off), "b4": 2 * off.sum(0)}
    back = (2 * off) @ p["w4"].T * (1 - late**2)
    out |= {"w3": code.T @ back, "b3": back.sum(0)}
    back = back @ p["w3"].T
    back = back * (np.abs(plain) <= 1) if training.binary else back
    out |= {"w2": units.T @ back, "b2": back.sum(0)}
    back = back @ p["w2"].T * (1 - units**2)
    return out | {"w1": seen.T @ back, "b1": back.sum(0)}, float((off.astype(np.float64) ** 2).sum()), int(hidden.sum())


class Adam:
    """One member's parameters and moments."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = parameters, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in parameters.items()} for _ in range(2))

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, x in g.items():
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.v[k] += np.float32(0.001) * (x * x - self.v[k])
            size = np.sqrt(self.v[k] / np.float32(1 - 0.999**self.step)) + np.float32(1e-8)
            self.p[k] = self.p[k] - np.float32(self.rate / (1 - 0.9**self.step)) * self.m[k] / size


class Weights:
    """Members' parameters, broadcast in column blocks."""

    def __init__(self, spark, members: dict[int, dict[str, np.ndarray]], width: int):
        send = spark.sparkContext.broadcast
        self.small = send({m: {k: p[k] for k in ("b1", "w2", "b2", "w3", "b3")} for m, p in members.items()})
        inputs = len(next(iter(members.values()))["b4"])
        self.slices = _blocks(inputs, width)
        self.blocks = [send({m: (p["w1"][s], p["w4"][:, s], p["b4"][s]) for m, p in members.items()}) for s in self.slices]

    def member(self, m: int) -> dict[str, np.ndarray]:
        own = [b.value[m] for b in self.blocks]
        return self.small.value[m] | {"w1": np.concatenate([b[0] for b in own]), "w4": np.concatenate([b[1] for b in own], axis=1), "b4": np.concatenate([b[2] for b in own])}

    def members(self) -> list[int]:
        return sorted(self.small.value)

    def drop(self) -> None:
        for b in [self.small, *self.blocks]:
            b.destroy()


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(t, inputs) of some rows at a time, of CHUNK floats at most (one row at least)."""
    for f in frames:
        rows = max(1, CHUNK // max(1, len(f["x"].iloc[0]))) if len(f) else 1
        for i in range(0, len(f), rows):
            yield f["t"].iloc[i : i + rows].to_numpy(), np.stack(f["x"].iloc[i : i + rows]).astype(np.float32)


def _sums(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(b, np.float64) for b in frame["sums"]], axis=0)
    return pd.DataFrame({"member": frame["member"].iloc[:1], "block": frame["block"].iloc[:1], "sums": [total.tobytes()]})


_SMALL = ("b1", "w2", "b2", "w3", "b3")


def summed_gradients(wide: DataFrame, weights: Weights, width: int, training: Training, step: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(member, column block or -1 for the rest with squared error and number in front, sums) over all rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = list(_chunks(frames))
        for m in weights.members() if data else []:
            p, total = weights.member(m), None
            for t, x in data:
                g, error, n = gradients(x, t, width, p, training, m, step)
                g["head"] = np.array([error, n])
                total = g if total is None else {k: total[k] + v for k, v in g.items()}
            packed = [(-1, np.concatenate([total[k].ravel().astype(np.float64) for k in ("head", *_SMALL)]))]
            packed += [(i, np.concatenate([x.ravel().astype(np.float64) for x in (total["w1"][s], total["w4"][:, s], total["b4"][s])])) for i, s in enumerate(weights.slices)]
            for i, sums in packed:
                yield pd.DataFrame({"member": [m], "block": [i], "sums": [sums.tobytes()]})

    parts = wide.mapInPandas(run, "member int, block int, sums binary")
    for r in parts.groupBy("member", "block").applyInPandas(_sums, "member int, block int, sums binary").toLocalIterator():
        yield r["member"], r["block"], np.frombuffer(r["sums"], np.float64)


def train(wide: DataFrame, inputs: int, width: int, training: Training) -> list[dict[str, np.ndarray]]:
    """Each member's parameters, from rows (t, x) of `inputs` numbers, `width` for each channel."""
    spark, out = wide.sparkSession, {}
    size = sum(v.size for v in first_parameters(inputs, training, 0).values())
    together = max(1, AT_ONCE // size)
    for first in range(0, training.members, together):
        state = {m: Adam(first_parameters(inputs, training, m), training.rate) for m in range(first, min(first + together, training.members))}
        for step in range(training.steps):
            weights = Weights(spark, {m: s.p for m, s in state.items()}, width)
            g = {m: {k: np.zeros_like(v) for k, v in s.p.items()} for m, s in state.items()}
            hidden = dict.fromkeys(state, 0.0)
            for m, block, sums in summed_gradients(wide, weights, width, training, step):
                if block < 0:
                    hidden[m], at = sums[1], 2
                    for k in _SMALL:
                        g[m][k][...] = sums[at : at + g[m][k].size].reshape(g[m][k].shape)
                        at += g[m][k].size
                else:
                    s = weights.slices[block]
                    n = (s.stop - s.start) * training.units
                    g[m]["w1"][s], g[m]["w4"][:, s], g[m]["b4"][s] = sums[:n].reshape(-1, training.units), sums[n : 2 * n].reshape(training.units, -1), sums[2 * n :]
            weights.drop()
            for m, s in state.items():
                if hidden[m]:
                    s.update({k: v / np.float32(hidden[m]) for k, v in g[m].items()})
        out |= {m: s.p for m, s in state.items()}
    return [out[m] for m in range(training.members)]


def encoded(wide: DataFrame, model: list[dict[str, np.ndarray]], width: int, training: Training) -> DataFrame:
    """(t, code, width): each time's codes of all members, one after another, and the length of one."""
    weights = Weights(wide.sparkSession, dict(enumerate(model)), width)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t, x in _chunks(frames):
            codes = [encode(x, weights.member(m), training.binary)[2] for m in weights.members()]
            yield pd.DataFrame({"t": t, "code": list(np.concatenate(codes, axis=1).astype(np.float64)), "width": training.code})

    return wide.select("t", "x").mapInPandas(run, "t long, code array<double>, width int")


def memberships(wide: DataFrame, channels: list[str], model: list[dict[str, np.ndarray]], width: int, training: Training, draws: int = 1) -> DataFrame:
    """(channel, membership, spread): R2, 0 at least, with which members recreate a hidden channel from the others, and its deviation over members.

    Hiding one channel changes the first layer by its own few columns and only its own outputs are asked for, so a channel costs
    times x units squared, not another pass over all inputs. With uniform fill the R2 is averaged over `draws` fills.
    """
    weights = Weights(wide.sparkSession, dict(enumerate(model)), width)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for t, x in _chunks(frames):
            for m in weights.members():
                p = weights.member(m)
                before = x @ p["w1"] + p["b1"]
                for d in range(draws):
                    fill = np.float32(4) * uniforms(t, x.shape[1], training.seed, m, d, 2) - np.float32(2) if training.fill == "uniform" else np.zeros_like(x)
                    sums = total.setdefault((m, d), np.zeros((len(channels), 4)))
                    for c in range(len(channels)):
                        s = slice(c * width, (c + 1) * width)
                        own = x[:, s].astype(np.float64)
                        plain = np.tanh(before + (fill[:, s] - x[:, s]) @ p["w1"][s]) @ p["w2"] + p["b2"]
                        code = np.where(plain >= 0, np.float32(1), np.float32(-1)) if training.binary else plain
                        off = np.tanh(code @ p["w3"] + p["b3"]) @ p["w4"][:, s] + p["b4"][s] - own
                        sums[c] += (own.size, own.sum(), (own**2).sum(), (off**2).sum())
        for (m, d), sums in total.items():
            yield pd.DataFrame({"channel": channels, "member": m, "draw": d, "n": sums[:, 0], "s": sums[:, 1], "q": sums[:, 2], "e": sums[:, 3]})

    parts = wide.select("t", "x").mapInPandas(run, "channel string, member int, draw int, n double, s double, q double, e double")
    sums = parts.groupBy("channel", "member", "draw").agg(*(F.sum(c).alias(c) for c in "nsqe"))
    r2 = F.greatest(F.lit(0.0), 1 - F.col("e") / F.col("n") / (F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2 + 1e-12))
    each = sums.groupBy("channel", "member").agg(F.avg(r2).alias("r2"))
    return each.groupBy("channel").agg(F.avg("r2").alias("membership"), F.stddev_pop("r2").alias("spread"))
