"""Documents whose word-shingle sets have a high Jaccard similarity: the size-aware heavy-light join.

Equal sets are one set from the start (a row each document, links between sets), so groups of copies cost nothing.

Light sets (size up to a boundary) are joined by enumeration: two sets of sizes n and m link if they share c(n, m) shingles,
so each set's subsets of every size c that a partner may ask for are hashed; sets with an equal subset link without
further checks, and linking each to the smallest set of the subset keeps their components.

Heavy sets are joined by inverted lists over each set's rarest shingles, as many as it may miss plus one (any linked
pair meets in one of these lists; frequencies come from a count sketch of fixed size over all documents, which only sets
the order). All pairs of a short list are candidates; in a longer one each set first meets a few neighbours in two orders and the
smallest set. Candidates of fitting size and near parity bitmaps (a short one first, then one as long as the set) are compared: in each round
a set travels to one partner alone, links found are contracted to components, and pairs inside a component need no comparison. Then
every such pair of a long list whose sets are still of different components is compared, so no link between components is lost and
tight groups never form all pairs. Lists of very frequent shingles
are dealt over several buckets by a salt and meet again in the second step.

The boundary minimises the cost of both parts over the corpus's histogram of sizes. Comparisons are exact on the full sets
(64-bit shingle hashes). Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased; a text with fewer
words than a shingle has its whole sequence as one. Defined results: null or empty text has no set, links with nothing
and is its own component; repeated rows are equal sets; a null id is never a component's name unless no other is there;
other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing, routed
from .graph import components
from .runtime import few, released, stored, text_chunks

SKETCH_BITS, SKETCH_PARTS = routed.SKETCH_BITS, routed.SKETCH_PARTS
#: Sets of a list that one bucket takes before the list is dealt over more.
HOT_LIST = 1 << 18
#: Sets of a list up to which all its pairs are candidates at once, and neighbours that each set of a longer list meets at first in
#: each of two orders (by size, by hash).
SHORT_LIST, MEETINGS = 8, 3
#: Cost of an inverted-list entry (scan and comparisons), in hashed subsets.
LIST_COST = 16
#: Ids up to which the fetch of texts broadcasts them (16 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 1 << 21
#: Partners that one copy of a set is compared with, and rounds in which each set is compared with one partner.
HUB, ROUNDS = 64, 2
_LIGHT, _HOT = 1 << 62, 1 << 61
_LINK, _CANDIDATE, _REST = 0, 1, 2
#: Sets that a task compares.
TASK_SETS = 1 << 11
#: Words of a set's parity bitmap. Its bits flip with each shingle, so two sets' bitmaps differ in no more bits than the sets in shingles.
BITMAP_WORDS = 8


def needed(size: int, percent: int) -> int:
    """The fewest shingles that a set of this size shares with any partner."""
    return (size * percent + 99) // 100


def overlap(n: int, m: int, percent: int) -> int:
    """The fewest shared shingles with which sets of n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """The subset sizes that partners of at most `boundary` shingles may ask of a set of n."""
    most = min(boundary, n * 100 // percent)
    return sorted({c for m in range(needed(n, percent), most + 1) if (c := overlap(n, m, percent)) <= min(n, m)})


def choose_boundary(histogram: dict[int, int], percent: int, list_cost: int = LIST_COST, top: int = 48) -> int:
    """The light sets' largest size: the least cost of subsets enumerated plus inverted-list entries."""

    def cost(boundary: int) -> int:
        total = 0
        for n, count in histogram.items():
            if 0 < n <= boundary:
                total += count * sum(comb(n, c) for c in subset_sizes(n, boundary, percent))
            if n > boundary or n * 100 // percent > boundary:
                total += count * list_cost * (n - needed(n, percent) + 1)
        return total

    return min(range(top + 1), key=cost)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    flat, rows = hashing.shingle_hashes(*hashing.word_hashes(data, offsets), size)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        own = np.sort(flat[a:b])
        if b - a > 1:
            keep = np.empty(b - a, bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        out.append(own)
    return out


def set_id(own: np.ndarray) -> np.uint64:
    return hashing.mix(np.array([hashing.mix(own).sum() + np.uint64(len(own))], np.uint64))[0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sets_and_sketch(rows: DataFrame, size: int) -> DataFrame:
    """kind 0: key, text_hash, n, set_id and bitmap words of each row; kind 1: a task's counts of shingle hashes, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        names = ["kind", "key", "text_hash", "n", "set_id", "counts", *_words()]
        for batch in batches:
            sizes, ids, bits = [], [], []
            for _, data, offsets in text_chunks(batch.column(2)):
                own = shingle_sets(data, offsets, size)
                sizes += [len(s) for s in own]
                ids += [set_id(s) for s in own]
                bits += [bitmap(s) for s in own]
                sketch += np.bincount((np.concatenate(own) & mask).astype(np.int64), minlength=1 << SKETCH_BITS)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), _signed(np.array(ids, np.uint64)), pa.nulls(n, pa.binary()), *(pa.array(b, pa.int64()) for b in np.array(bits, np.int64).reshape(n, BITMAP_WORDS).T)], names)
        parts = np.minimum(sketch, 2**31 - 1).astype("<i4").reshape(SKETCH_PARTS, -1)
        if parts.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SKETCH_PARTS, np.int32)), pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.int64()), pa.array(np.arange(SKETCH_PARTS)), pa.nulls(SKETCH_PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()), *(pa.nulls(SKETCH_PARTS, pa.int64()) for _ in range(BITMAP_WORDS))], names)

    return rows.mapInArrow(run, ", ".join(["kind int, key long, text_hash long, n long, set_id long, counts binary", *(f"{w} long" for w in _words())]))


def subset_keys(own: np.ndarray, boundary: int, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """(hashes of the subsets of size c, c) for each c asked of a light set."""
    mixed = hashing.mix(own)
    for c in subset_sizes(len(own), boundary, percent):
        gone = np.array([*combinations(range(len(own)), len(own) - c)], np.int64).reshape(comb(len(own), c), len(own) - c)
        with np.errstate(over="ignore"):
            yield hashing.mix(mixed.sum() - mixed[gone].sum(axis=1, dtype=np.uint64) + np.uint64(c * 0x9E3779B9)), c


def _entries(rows: DataFrame, size: int, percent: int, boundary: int, buckets: int, sketch: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        counts, mask = shared.value, np.uint64((1 << SKETCH_BITS) - 1)
        shipper, seen = routed.Shipper(buckets), set()
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(2)):
                for own in shingle_sets(data, offsets, size):
                    n = len(own)
                    ident = set_id(own)
                    if not n or ident in seen:
                        continue
                    seen.add(ident)
                    if n <= boundary:
                        for keys, c in subset_keys(own, boundary, percent):
                            shipper.add(keys, ident, np.uint64(_LIGHT | c << 32 | n))
                    if n > boundary or n * 100 // percent > boundary:
                        count = counts[(own & mask).astype(np.int64)]
                        rare = np.argsort(count, kind="stable")[: n - needed(n, percent) + 1]
                        deals = 1 + count[rare] // HOT_LIST
                        salt = (ident % deals.astype(np.uint64)) * np.uint64(0x9E3779B1)
                        shipper.add(own[rare], ident, np.where(deals > 1, _HOT | n, n).astype(np.uint64), salt)
                if shipper.held >= routed.FLUSH:
                    yield from shipper.rows()
            if len(seen) > 1 << 20:
                seen.clear()
        yield from shipper.rows()

    return rows.mapInArrow(run, routed.SCHEMA)


def _met(entries: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Links of light sets, candidates of heavy lists, and the rows of long lists."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        e, edges = routed.unpacked(frame["entries"])
        run_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        at = np.flatnonzero(np.diff(edges)[run_of] > 1) if len(e) else np.zeros(0, np.int64)
        first, count = edges[run_of[at]], np.diff(edges)[run_of[at]]
        aux = e["aux"].astype(np.int64)
        n, light, hot = aux & 0xFFFFFFFF, (aux & _LIGHT) > 0, (aux & _HOT) > 0
        out = []

        def add(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> None:
            out.append(pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "key": key.view(np.int64), "a": a.view(np.int64), "b": b.view(np.int64), "n": size}))

        c = (aux & ~(_LIGHT | _HOT)) >> 32
        link = at[(at > first) & light[at]]
        head = edges[run_of[link]]
        good = c[link] * 100 >= (n[head] + n[link] - c[link]) * percent
        add(_LINK, e["key"][link[good]], e["id"][head[good]], e["id"][link[good]], n[link[good]])
        heavy = at[~light[at]]
        length, begin = np.diff(edges)[run_of[heavy]], edges[run_of[heavy]]

        def candidates(x: np.ndarray, y: np.ndarray) -> None:
            x, y = np.minimum(x, y), np.maximum(x, y)  # places stand by size
            fit = (n[y] * percent <= n[x] * 100) & (n[y] > boundary) & (e["id"][x] != e["id"][y])
            x, y = x[fit], y[fit]
            add(_CANDIDATE, e["key"][y], np.minimum(e["id"][x], e["id"][y]), np.maximum(e["id"][x], e["id"][y]), n[y])

        short = length <= SHORT_LIST
        for step in range(1, SHORT_LIST):
            x = heavy[short & (heavy - begin + step < length)]
            candidates(x, x + step)
        large = heavy[~short]
        head = edges[run_of[large]]
        candidates(head[large > head], large[large > head])
        for order in (large, large[np.lexsort((hashing.mix(e["id"][large] ^ e["key"][large]), e["key"][large]))] if len(large) else large):
            for step in range(1, MEETINGS + 1):
                same = np.flatnonzero(e["key"][order[step:]] == e["key"][order[:-step]]) if len(order) > step else np.zeros(0, np.int64)
                candidates(order[same], order[same + step])
        every = np.flatnonzero(~light & ((np.diff(edges)[run_of] > SHORT_LIST) | hot)) if len(e) else at
        add(_REST, e["key"][every], e["id"][every], e["id"][every], n[every])
        return pd.concat(out)

    return entries.groupBy("bucket").applyInPandas(run, "kind int, key long, a long, b long, n long")


def bitmap(own: np.ndarray) -> np.ndarray:
    bits = np.bincount((own & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def parities(own: np.ndarray) -> np.ndarray:
    """bitmap() with a bit or more for each shingle, so that it tells apart sets of any size; the first halves and second halves of it, flipped
    together, are the one of half the length."""
    bits = max(64 * BITMAP_WORDS, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the shingles that are in one of two sets alone, from their parities()."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _read(rows: DataFrame, distinct: DataFrame, asked: DataFrame, count: int, size: int, shown: Callable[[np.ndarray], bytes]) -> DataFrame:
    """asked (id, further longs; about `count` rows) with n and what is shown of each id's set, from the one text that stands for the set."""
    names = [c for c in asked.columns if c != "id"]
    texts = asked.join(distinct.select("id", "n", "at"), "id").select("id", *names, "n", F.col("at.key").alias("_key"), F.col("at.text_hash").alias("_hash"))
    texts = stored(few(texts, count), "texts")
    wanted = F.broadcast(texts) if texts.count() <= BROADCAST_IDS else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            sets = []
            for _, data, offsets in text_chunks(batch.column(0)):
                sets += [shown(s) for s in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], ["id", *names, "n", "set"])

    chosen = rows.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key"))).select("text", "id", *names, "n")
    return chosen.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", *names, "n")) + ", set binary")


def _probable(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities don't rule a link out."""
    count = pairs.count()
    ids = few(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), count)
    maps = few(stored(_read(rows, distinct, ids, count, size, lambda own: parities(own).tobytes()), "parities").dropDuplicates(["id"]), count, TASK_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = n + m - 2 * -(-percent * (n + m) // (100 + percent))
            keep = [apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= k for x, y, k in zip(batch.column(4), batch.column(5), most)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = few(few(pairs.join(maps.toDF("a", "n", "x"), "a"), count, TASK_SETS).join(maps.toDF("b", "m", "y"), "b"), count, TASK_SETS)
    return joined.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _words(prefix: str = "b") -> list[str]:
    return [f"{prefix}{k}" for k in range(BITMAP_WORDS)]


def _near(percent: int, boundary: int, x: str = "x", y: str = "y") -> Column:
    """What two linked sets' sizes (nx, ny) and bitmaps fulfil; only pairs with a heavy set are asked about."""
    n = F.col(f"n{x}") + F.col(f"n{y}")
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in range(BITMAP_WORDS)))
    fits = (F.greatest(f"n{x}", f"n{y}") * percent <= F.least(f"n{x}", f"n{y}") * 100) & (F.greatest(f"n{x}", f"n{y}") > boundary)
    return fits & (apart <= n - 2 * F.expr(f"(n{x} + n{y}) * {percent} div {100 + percent}"))


def _filtered(pairs: DataFrame, count: int, distinct: DataFrame, percent: int, boundary: int) -> DataFrame:
    left = distinct.select(F.col("id").alias("a"), F.col("n").alias("nx"), *(F.col(w).alias(f"x{w[1:]}") for w in _words()))
    right = distinct.select(F.col("id").alias("b"), F.col("n").alias("ny"), *(F.col(w).alias(f"y{w[1:]}") for w in _words()))
    return few(few(pairs.join(left, "a"), count).join(right, "b"), count).where(_near(percent, boundary)).select("a", "b")


def _compared(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. A set travels once for each of its partners a; a's own set once for `HUB` of its partners."""
    count = pairs.count()
    hubs = few(pairs.groupBy("a").agg(F.expr(f"count(*) div {HUB} + 1").alias("parts")), count)
    partners = few(pairs.join(hubs, "a"), count).select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    own = hubs.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        hub = frame["hub"].iloc[0]
        sets = {i: np.frombuffer(s, np.uint64) for i, s in zip(frame["id"], frame["set"])}
        x, found = sets.pop(hub), []
        for i, y in sets.items():
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                found.append(i)
        return pd.DataFrame({"a": np.full(len(found), hub, np.int64), "b": np.array(found, np.int64)})

    sets = _read(rows, distinct, partners.unionByName(own), 2 * count, size, np.ndarray.tobytes)
    return few(sets.groupBy("hub", "part").applyInPandas(run, "a long, b long"), 2 * count, TASK_SETS)


def _joined(links: DataFrame, reached: DataFrame | None, pairs: DataFrame, rows: DataFrame, distinct: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (node, component) of links and of those pairs that link. Each set is first compared with one partner, and pairs of sets that
    are of one component by then are not compared; after `ROUNDS` of this all that are left are."""
    if reached is not None:
        links = links.unionByName(reached.select(F.col("node").alias("a"), F.col("component").alias("b")))
    for k in range(ROUNDS + 1):
        count = pairs.count()
        if count:
            chosen = stored(few(pairs.groupBy("b").agg(F.min("a").alias("a")), count).select("a", "b"), "chosen") if k < ROUNDS else pairs
            links = stored(links.unionByName(_compared(chosen, rows, distinct, size, percent)), "links")
            pairs = few(pairs.join(chosen, ["a", "b"], "left_anti"), count)
        elif k:
            break
        reached = stored(components(links), "reached")
        left, right = reached.toDF("a", "ca"), reached.toDF("b", "cb")
        apart_ = few(few(pairs.join(left, "a", "left"), count).join(right, "b", "left"), count).where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        pairs = stored(apart_.select("a", "b"), "pairs")
    return reached


def jaccard_components(documents: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", list_cost: int = LIST_COST) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of each row."""
    spark: SparkSession = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    both = stored(_sets_and_sketch(rows, size), "shingle-sets")
    sets = both.where("kind = 0").select("key", "text_hash", "n", "set_id", *_words())
    fixed = (F.min(c).alias(c) for c in ("n", *_words()))
    n_rows = both.where("kind = 0").count()
    distinct = stored(few(sets.where("n > 0").groupBy(F.col("set_id").alias("id")).agg(*fixed, F.min(F.struct("key", "text_hash")).alias("at")), n_rows), "distinct-sets")
    histogram = {r["m"]: r["count"] for r in distinct.groupBy(F.least("n", F.lit(64)).alias("m")).count().collect()}
    boundary = choose_boundary(histogram, percent, list_cost)
    volume = distinct.agg(F.sum("n").alias("n")).first()["n"] or 0
    light = sum(c * sum(comb(n, s) for s in subset_sizes(n, boundary, percent)) for n, c in histogram.items() if n <= boundary)
    buckets = max(16, int((volume * (100 - percent) // 100 + light) // routed.PER_BUCKET))

    entries = _entries(rows, size, percent, boundary, buckets, routed.summed(both.where("kind = 1").select(F.col("n").cast("int").alias("part"), "counts")))
    met = stored(_met(entries, percent, boundary), "met")
    counts = met.agg(*(F.count_if(F.col("kind") == k).alias(str(k)) for k in (_LINK, _CANDIDATE, _REST))).first()
    links = stored(few(met.where(F.col("kind") == _LINK).select("a", "b").distinct(), counts[_LINK]), "links")
    pairs = few(met.where(F.col("kind") == _CANDIDATE).select("a", "b").distinct(), counts[_CANDIDATE])
    rest = met.where(F.col("kind") == _REST).select("key", F.col("a").alias("id"), "n")
    near = stored(_filtered(pairs, counts[_CANDIDATE], distinct, percent, boundary), "near")
    reached = _joined(links, None, stored(_probable(near, rows, distinct, size, percent), "probable"), rows, distinct, size, percent)

    rest = stored(few(rest.join(reached, rest["id"] == reached["node"], "left"), counts[_REST]).select("key", "id", F.coalesce("component", "id").alias("c")), "rest")
    split = few(rest.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key"), counts[_REST])
    rest = few(few(rest.join(split, "key", "left_semi"), counts[_REST]).join(distinct.drop("at"), "id"), counts[_REST]).select("key", "id", "c", "n", *_words())
    x, y = rest.toDF("key", "a", "ca", "nx", *_words("x")), rest.toDF("key", "b", "cb", "ny", *_words("y"))
    others = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near(percent, boundary)).select("a", "b").distinct()
    others = stored(_probable(stored(others, "others"), rows, distinct, size, percent), "probable")
    if not others.isEmpty():
        reached = _joined(links.limit(0), reached, others, rows, distinct, size, percent)

    named = few(sets.select("key", "n", "set_id").join(reached.withColumnRenamed("node", "set_id"), "set_id", "left"), n_rows).withColumn("c", F.coalesce("component", "set_id"))
    least = few(named.where("n > 0").groupBy("c").agg(F.min("key").alias("least")), n_rows)
    named = few(named.join(least, "c", "left"), n_rows).select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))
    return named.withColumnRenamed("key", key)
