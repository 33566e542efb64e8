"""Line deduplication by a segment-partition edit join.

Lines (between line feeds) of at least `least` characters are compared by edit distance over code points. Each distinct
line is split into threshold+1 even segments, entered in an index under (length, segment's place, segment), and probes
it with its own substrings at the places that a partner of each length within the threshold allows (multi-match-aware
windows). Lines that meet and whose character counts differ by few enough are verified by banded bit-parallel edit distance. Linked
lines form classes (components); of a class the first occurrence by (document id, position) stays, others are dropped.

In an index list with many meetings each line is first compared with its neighbours and the list's first line; links are contracted, and
the pairs of the list that are still of different classes are compared after that, in blocks, so no link is lost and tight groups
never form all pairs. Lists that a count sketch finds longer than `HOT_LIST` are dealt over several buckets by a salt and meet in that last
step. An entry stands for the probe that equals it. Exact copies are one line from the start: lines are joined by a 64-bit hash, and of one class by that and another 64 bits.

Defined results: null or empty text has no line to drop; shorter lines stay, whatever their copies; repeated rows with the same id and text
are one document and keep the same lines; a null id counts as the smallest; documents left without any text stay as rows here;
other columns are carried along; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, routed
from .graph import components
from .hashing import U
from .runtime import free_name, released, stored, text_chunks

#: Meetings of one list up to which all its pairs are compared at once, and lines of a block beyond it.
LIST_PAIRS, BLOCK = 4096, 1024
#: Index entries of a list that one bucket takes before the list is dealt over more.
HOT_LIST = 1 << 18
BROADCAST_IDS = 1 << 21
#: Rows of a stored table of lines (two or three longs each) up to which it is broadcast.
BROADCAST_LINES = BROADCAST_IDS // 4
#: Bytes of text that are cut into lines at once, so that their arrays stay in a core's cache, and keys that a sketch takes at once.
CHUNK, COUNTED = 1 << 18, 1 << 20
_CLASSES = 15
#: Characters that are counted at once in fields of eight bits.
_FIELD = 255
_PROBE, _HOT = U(1) << U(63), U(1) << U(62)


def _values(codes: np.ndarray) -> np.ndarray:
    return hashing.mix(codes.astype(np.uint64) + U(1))


def _counters(codes: np.ndarray, half: int) -> np.ndarray:
    """1 in the eight-bit field of the character's class, if that is one of the first eight (half 0) or the others (half 1)."""
    kind = _values(codes) % U(_CLASSES)
    return np.where(kind // U(8) == half, U(1) << kind % U(8) * U(8), U(0))


_LOW = np.arange(1 << 16)
_TABLES = [_values(_LOW), _counters(_LOW, 0), _counters(_LOW, 1)]


class Lines:
    """The long enough lines of a run of texts, as code points with prefix hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        self.data = data
        feeds = np.flatnonzero(data == 10)
        count = np.diff(np.searchsorted(feeds, offsets, "left")) + 1
        self.n_lines = count
        row = np.repeat(np.arange(len(count)), count)
        begins = np.cumsum(count) - count
        starts, ends = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        first, last = np.zeros(len(row), bool), np.zeros(len(row), bool)
        first[begins], last[begins + count - 1] = True, True
        starts[first], ends[last] = offsets[:-1], offsets[1:]
        starts[~first], ends[~last] = feeds + 1, feeds
        place = np.arange(len(row)) - np.repeat(begins, count)
        following = np.flatnonzero((data & 0xC0) == 0x80) if len(data) and data.max() >= 0x80 else np.zeros(0, np.int64)
        self.plain = not len(following)
        begin, end = (starts, ends) if self.plain else (x - np.searchsorted(following, x) for x in (starts, ends))
        keep = end - begin >= least
        self.row, self.place, self.starts, self.ends, self.at = row[keep], place[keep], begin[keep], end[keep], (starts[keep], ends[keep])
        self.ids = hashing.span_hashes(data, *self.at, 1)

    @cached_property
    def codes(self) -> np.ndarray:
        codes = self.data if self.plain else np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        return codes.astype(np.int64)

    @cached_property
    def above(self) -> np.ndarray:
        return np.flatnonzero(self.codes >= len(_LOW)) if not self.plain else np.zeros(0, np.int64)

    def looked_up(self, table: int) -> np.ndarray:
        """`_values`, or `_counters` of one half, of all characters."""
        out = _TABLES[table].take(self.codes, mode="clip")
        if len(self.above):
            codes = self.codes[self.above]
            out[self.above] = _counters(codes, table - 1) if table else _values(codes)
        return out

    @cached_property
    def checks(self) -> np.ndarray:
        return hashing.span_hashes(self.data, *self.at, 2)

    @cached_property
    def sums(self) -> np.ndarray:
        sums = np.zeros(len(self.codes) + 1, np.uint64)
        values = self.looked_up(0)
        values *= hashing._tables(len(self.codes) + 1)[0][: len(self.codes)]
        np.cumsum(values, out=sums[1:])
        return sums

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = hashing._tables(len(self.codes) + 1)[1]
        return hashing.mix((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def signatures(self, which: np.ndarray) -> np.ndarray:
        """Counts modulo 16 of 15 classes of characters, four bits each, of lines in rising order."""
        starts, ends = self.starts[which], self.ends[which]
        blocks = np.maximum(1, -(-(ends - starts) // _FIELD))
        first = np.cumsum(blocks) - blocks
        line = np.repeat(np.arange(len(which)), blocks)
        bounds = np.empty((len(line), 2), np.int64)
        bounds[:, 0] = starts[line] + _FIELD * (np.arange(len(line)) - first[line])
        bounds[:, 1] = np.minimum(bounds[:, 0] + _FIELD, ends[line])
        out, empty = np.zeros(len(which), np.uint64), bounds[:, 0] == bounds[:, 1]
        for half in range(2) if len(which) else ():
            counts = np.add.reduceat(np.append(self.looked_up(1 + half), U(0)), bounds.ravel())[::2]
            counts[empty] = 0
            for k in range(8 * half, min(_CLASSES, 8 * half + 8)):
                out |= (np.add.reduceat(counts >> U(8 * k - 64 * half) & U(255), first) & U(15)) << U(4 * k)
        return out

    def keys(self, which: np.ndarray, threshold: int, entries_alone: bool = False, own: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(key, line, whether it probes) of the index entries and probes of some lines; own: with the probes that equal an entry of their line."""
        size, starts = (self.ends - self.starts)[which], self.starts[which]
        parts = threshold + 1
        for shorter in range(1 if entries_alone else threshold + 1):
            other = size - shorter
            for i in range(parts):
                begin = i * (other // parts) + np.maximum(0, i - (parts - other % parts))
                width = other // parts + (i >= parts - other % parts)
                tag = hashing.mix(other.astype(np.uint64) * U(64) + U(i))
                low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
                for shift in (0,) if entries_alone else range(low, high + 1):
                    at = begin + shift
                    good = np.flatnonzero((at >= 0) & (at + width <= size) & (width > 0))
                    key = hashing.mix(self.spans(starts[good] + at[good], starts[good] + at[good] + width[good]) + tag[good])
                    if not entries_alone and (own or shorter or shift):
                        yield key, which[good], True
                    if not shorter and not shift:
                        yield key, which[good], False


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of twice the edit distance from two arrays of signatures."""
    total = np.zeros(len(a), np.int64)
    for k in range(_CLASSES):
        d = ((a >> U(4 * k)) - (b >> U(4 * k))) & U(15)
        total += np.minimum(d, U(16) - d).astype(np.int64)
    return total


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance if it is at most `most`, else most + 1: bit-parallel over the band of 2 * most + 1 diagonals."""
    limit = most
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b or most == 0:
        return min(len(a), most + 1)
    most = min(most, len(a))  # a distance never exceeds it
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down = (full << (width - most - 1)) & full, 0  # rises and falls between neighbours of the band's column
    distance, low, edge = most, most + 1 - width, top >> 1
    for j, c in enumerate(b):
        seen = where.get(c, 0)
        match = (seen >> low if low >= 0 else seen << -low) & full
        zero = (((match & up) + up) ^ up | match | down) & full
        rise, fall = (down | ~(zero | up)) & full, zero & up
        if j < len(a) - most:
            distance += not zero & top
        else:
            distance += bool(rise & edge) - bool(fall & edge)
            edge >>= 1
        up, down = (fall | ~(zero >> 1 | rise)) & full, zero >> 1 & rise
        low += 1
    return min(distance, limit + 1)


class Seen:
    """The lines that a task has had."""

    def __init__(self):
        self.ids = np.zeros(0, np.uint64)

    def new(self, lines: Lines) -> np.ndarray:
        """The places, rising, of the lines that this task hasn't had yet."""
        ids, which = np.unique(lines.ids, return_index=True)
        place = np.searchsorted(self.ids, ids)
        new = np.append(self.ids, U(0))[place] != ids
        new[place == len(self.ids)] = True
        self.ids = np.insert(self.ids, place[new], ids[new]) if len(self.ids) < 1 << 20 else ids  # stays sorted
        return np.sort(which[new])


def _scanned(rows: DataFrame, least: int, threshold: int) -> DataFrame:
    """kind 0: each line's place; kind 1: each row's number of lines (line); kind 2: parts (place) of a count sketch of the index entries' keys."""
    names = ["kind", "key", "row", "place", "line", "check", "counts"]
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]

    def cut(size: int, kind: int, **columns) -> pa.RecordBatch:
        columns["kind"] = np.full(size, kind, np.int32)
        given = {n: c if isinstance(c, pa.Array) else pa.array(c) for n, c in columns.items()}
        return pa.RecordBatch.from_arrays([given[n].cast(t) if n in given else pa.nulls(size, t) for n, t in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        seen, counts, held = Seen(), np.zeros(1 << routed.SKETCH_BITS, np.int64), []
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(2), CHUNK):
                lines = Lines(data, offsets, least)
                n, at = len(lines.n_lines), first + lines.row
                yield cut(n, 1, key=batch.column(0).slice(first, n), row=batch.column(1).slice(first, n), line=np.where(np.diff(offsets) > 0, lines.n_lines, 0))
                yield cut(len(at), 0, key=batch.column(0).take(pa.array(at)), row=batch.column(1).take(pa.array(at)), place=lines.place, line=lines.ids.view(np.int64), check=lines.checks.view(np.int64))
                held += [key & U(len(counts) - 1) for key, _, _ in lines.keys(seen.new(lines), threshold, entries_alone=True)]
                if sum(map(len, held)) >= COUNTED:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
                    held = []
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
        sketch = routed.sketch_rows(counts)
        yield cut(len(sketch), 2, place=sketch.column(0).cast(pa.int64()), counts=sketch.column(1))

    return rows.select("key", "row", "text").mapInArrow(run, "kind int, key long, row long, place long, line long, check long, counts binary")


def _entries(rows: DataFrame, least: int, threshold: int, buckets: int, counts: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(counts) if (counts > HOT_LIST).any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        shipper, seen = routed.Shipper(buckets), Seen()
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), CHUNK):
                lines = Lines(data, offsets, least)
                which = seen.new(lines)
                signature = np.zeros(len(lines.ids), np.uint64)
                signature[which] = lines.signatures(which)
                for key, line, probes in lines.keys(which, threshold, own=False):
                    aux, salt = signature[line] | (_PROBE if probes else U(0)), None
                    if shared:
                        deals = U(1) + (shared.value[(key & U((1 << routed.SKETCH_BITS) - 1)).astype(np.int64)] // HOT_LIST).astype(np.uint64)
                        aux |= np.where(deals > 1, _HOT, U(0))
                        salt = lines.ids[line] % deals * U(0x9E3779B1)
                    shipper.add(key, lines.ids[line], aux, salt)
                if shipper.held >= routed.FLUSH:
                    yield from shipper.rows()
        yield from shipper.rows()

    return rows.select("text").mapInArrow(run, routed.SCHEMA)


def _pairs(entered: np.ndarray, probing: np.ndarray, entered_count: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (entry, probe) of all meetings, about `limit` at a time; entered: place of the first entry for each probe."""
    total = np.cumsum(entered_count)
    at = 0
    while at < len(probing):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        count = entered_count[at:end]
        yield np.repeat(entered[at:end] - (np.cumsum(count) - count), count) + np.arange(count.sum()), np.repeat(probing[at:end], count)
        at = end


def _met(entries: DataFrame, threshold: int) -> DataFrame:
    """kind 0: candidate pairs (a, b); kind 1: the entries and probes of lists with many meetings. An entry probes its own list too."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        e, edges = routed.unpacked(frame["entries"])
        probe = (e["aux"] & _PROBE) > 0
        entered = np.diff(np.concatenate([[0], np.cumsum(~probe)])[edges])  # entries of a list stand before its probes
        size = np.diff(edges)
        meet = entered * size
        run_of = np.repeat(np.arange(len(size)), size)
        out = []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            good = e["id"][x] != e["id"][y]
            x, y = x[good], y[good]
            good = differ(e["aux"][x] & ~_PROBE, e["aux"][y] & ~_PROBE) <= 2 * threshold
            a, b = e["id"][x[good]], e["id"][y[good]]
            out.append(pd.DataFrame({"a": np.minimum(a, b).view(np.int64), "b": np.maximum(a, b).view(np.int64)}).drop_duplicates())

        short = np.flatnonzero(((e["aux"] & _HOT) == 0) & ((meet > 1) & (meet <= LIST_PAIRS))[run_of]) if len(e) else np.zeros(0, np.int64)
        for x, y in _pairs(edges[run_of[short]], short, np.minimum(entered[run_of[short]], short - edges[run_of[short]])):
            keep(x, y)
        large = np.flatnonzero((meet > LIST_PAIRS)[run_of] | ((e["aux"] & _HOT) > 0)) if len(e) else short
        later = large[large > edges[run_of[large]]]
        keep(later - 1, later)
        keep(edges[run_of[later]], later)
        pairs = pd.concat(out).drop_duplicates().assign(kind=np.int32(0), key=0, aux=0)
        twice = large[~probe[large]]
        aux, large = np.concatenate([e["aux"][large], e["aux"][twice] | _PROBE]), np.concatenate([large, twice])
        rest = pd.DataFrame({"a": e["id"][large].view(np.int64), "b": 0, "kind": np.int32(1), "key": e["key"][large].view(np.int64), "aux": aux.view(np.int64)})
        return pd.concat([pairs, rest])[["kind", "key", "a", "b", "aux"]]

    return entries.groupBy("bucket").applyInPandas(run, "kind int, key long, a long, b long, aux long")


def _rest_pairs(rest: DataFrame, threshold: int) -> DataFrame:
    """Candidates (a, b) of lists (key, line, aux, class) whose lines are of different classes, block against block."""
    mixed = rest.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.sum(F.expr("int(aux < 0)")).alias("probes"), F.sum(F.expr("int(aux >= 0)")).alias("entered")).where("low <> high")
    blocks = rest.join(mixed, "key").withColumns({"pb": F.expr(f"probes div {BLOCK}"), "eb": F.expr(f"entered div {BLOCK}")})
    own = F.pmod(F.xxhash64("line"), F.when(F.col("aux") < 0, F.col("pb")).otherwise(F.col("eb")) + 1)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("aux") < 0, F.col("eb")).otherwise(F.col("pb"))))
    dealt = blocks.select("key", "line", "aux", "class", own.alias("own"), others.alias("other"))
    dealt = dealt.select("key", "line", "aux", "class", F.when(F.col("aux") < 0, F.col("own")).otherwise(F.col("other")).alias("p"), F.when(F.col("aux") < 0, F.col("other")).otherwise(F.col("own")).alias("q"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        line, aux, kind = frame["line"].to_numpy(), frame["aux"].to_numpy().view(np.uint64), frame["class"].to_numpy()
        probe = (aux & _PROBE) > 0
        x, y = np.flatnonzero(~probe), np.flatnonzero(probe)
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})]
        for j in y:
            i = x[kind[x] != kind[j]]
            i = i[differ(aux[i], np.broadcast_to(aux[j] & ~_PROBE, len(i))) <= 2 * threshold]
            out.append(pd.DataFrame({"a": np.minimum(line[i].view(np.uint64), line[j : j + 1].view(np.uint64)).view(np.int64), "b": np.maximum(line[i].view(np.uint64), line[j : j + 1].view(np.uint64)).view(np.int64)}))
        return pd.concat(out)

    return dealt.groupBy("key", "p", "q").applyInPandas(run, "a long, b long").distinct()


def _small(lines: DataFrame) -> DataFrame:
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def _fetched(rows: DataFrame, occurrences: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(line, check, value) of the lines asked for."""
    ids = stored(ids, "line-ids")
    places = stored(occurrences.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "line", "left_semi").groupBy("line").agg(F.min(F.struct("row", "place", "check")).alias("at")).select("line", "at.row", "at.place", "at.check"), "places")
    documents = places.groupBy("row").agg(F.collect_list(F.struct("place", "line", "check")).alias("wanted"))
    joined = rows.select("row", "text").join(F.broadcast(documents) if places.count() <= BROADCAST_LINES else documents, "row")
    values = joined.select(F.split("text", "\n", -1).alias("parts"), F.explode("wanted").alias("w")).select("w.line", "w.check", F.expr("parts[int(w.place)]").alias("value"))
    return stored(values.dropDuplicates(["line"]), "lines")


def _verified(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [edit_distance(x, y, threshold) <= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x, y = lines.select("line", "value").toDF("a", "x"), lines.select("line", "value").toDF("b", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(key).cast("long"), text).alias("row"), F.col(text).alias("text"))


def _marked(rows: DataFrame, threshold: int, least: int) -> tuple[DataFrame, DataFrame]:
    """((key, row, n_lines) of each row; (row, dropped) of each document with lines to drop)."""
    scanned = stored(_scanned(rows, least, threshold), "scanned")
    occurrences = scanned.where("kind = 0").select("key", "row", "place", "line", "check")
    counts = routed.summed(scanned.where("kind = 2").select(F.col("place").cast("int").alias("part"), "counts"))
    buckets = max(16, int(occurrences.count() * (threshold + 1) * (threshold + 2) // routed.PER_BUCKET))
    met = stored(_met(_entries(rows, least, threshold, buckets, counts), threshold), "met")
    pairs = stored(met.where("kind = 0").select("a", "b").distinct(), "pairs")
    rest = met.where("kind = 1").select("key", F.col("a").alias("line"), "aux")
    ids = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(rest.select("line")).distinct()
    lines = _fetched(rows, occurrences, ids, least)
    links = stored(_verified(pairs, lines, threshold), "links")
    reached = stored(components(links), "reached")
    rest = rest.join(reached, rest["line"] == reached["node"], "left").select("key", "line", "aux", F.coalesce("component", "line").alias("class"))
    more = stored(_verified(_rest_pairs(rest, threshold), lines, threshold), "more-links")
    if not more.isEmpty():
        reached = components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = _small(stored(lines.select("line", "check").join(reached.withColumnRenamed("node", "line"), "line"), "named"))
    # Most lines have neither a copy nor a link; only the others are grouped and joined by place.
    copied = occurrences.groupBy("line", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line", "check")
    copied = _small(stored(copied.union(named.select("line", "check")).distinct(), "copied"))
    occurrences = stored(occurrences.join(copied, ["line", "check"], "left_semi").join(named, ["line", "check"], "left"), "classed")
    # The first occurrence of a class, and of a line in no class; joined by place, not by class, so that no class is one task's.
    own = F.when(F.col("component").isNull(), F.struct("line", "check")).otherwise(F.struct(F.col("component").alias("line"), F.lit(0).cast("long").alias("check")))
    first = occurrences.groupBy(F.col("component").isNull().alias("alone"), own.alias("own")).agg(F.min(F.struct("key", "row", "place")).alias("first")).select("first.row", "first.place")
    dropped = occurrences.select("row", "place").join(first, ["row", "place"], "left_anti")
    return scanned.where("kind = 1").select("key", "row", F.col("line").alias("n_lines")), dropped.groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("dropped"))


def duplicate_lines(documents: DataFrame, threshold: int = 2, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, dropped): the places of the lines to drop, for each document that has any; row is a hash of id and text."""
    return _marked(_rows(documents, key, text), threshold, least)[1]


def dedup_lines(documents: DataFrame, threshold: int = 2, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with repeated lines cut from the text, and n_lines, n_dropped and dropped (places) of each row."""
    row, dropped = free_name("row", documents), free_name("dropped", documents)
    gone = duplicate_lines(documents, threshold, least, key, text).toDF(row, dropped)
    joined = documents.withColumn(row, F.xxhash64(F.col(key).cast("long"), text)).join(gone, row, "left").drop(row)
    parts = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))), lambda s: ~F.array_contains(dropped, s["i"]))["x"], "\n")
    return joined.select(
        *(F.when(F.col(dropped).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in documents.columns if c.lower() not in ("n_lines", "n_dropped", "dropped")),
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(dropped, F.expr("CAST(array() AS array<bigint>)")).alias("dropped"),
    )


def dropped_lines(documents: DataFrame, threshold: int = 2, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, n_dropped and dropped (places, comma-joined) of each row, without moving the texts."""
    counts, gone = _marked(_rows(documents, key, text), threshold, least)
    out = counts.join(gone, "row", "left")
    return out.select(F.col("key").alias(key), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.transform("dropped", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"))
