"""Gridded arrays as tables: a data source with a partition for each chunk, which reads only the chunks (and cells) of a window.

Formats: netCDF classic (CDF-1, CDF-2, CDF-5; records too) and zarr version 3 (regular chunks, codecs bytes, gzip and zstd). Both are read
through pyarrow's file systems, so paths may be local folders or addresses of shared stores.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a run of a netCDF variable that one partition reads.
RUN_BYTES = 4 << 20

# Fixed values of the netCDF classic format: external types by number, and tags of header lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Variable:
    """A netCDF variable: where its values stand and what they mean. `step` is the bytes from one record to the next (0: no records)."""

    name: str
    dimensions: list[str]
    shape: list[int]
    dtype: np.dtype
    begin: int
    step: int
    attributes: dict


class _Header:
    def __init__(self, stream):
        self._stream, magic = stream, stream.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a netCDF classic file")
        self._count, self._offset = ">q" if magic[3] == 5 else ">i", ">i" if magic[3] == 1 else ">q"

    def number(self, kind: str | None = None) -> int:
        kind = kind or self._count
        return struct.unpack(kind, self._stream.read(struct.calcsize(kind)))[0]

    def text(self) -> str:
        n = self.number()
        return self._stream.read(n + -n % 4)[:n].decode()

    def listed(self, tag: int) -> range:
        found, n = self.number(">i"), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("damaged netCDF header")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.listed(ATTRIBUTES):
            name, dtype, n = self.text(), np.dtype(TYPES[self.number(">i")]), self.number()
            size = n * dtype.itemsize
            raw = self._stream.read(size + -size % 4)[:size]
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if dtype.kind == "S" else np.frombuffer(raw, dtype).tolist()
        return out


def netcdf_variables(path: str) -> dict[str, Variable]:
    """The variables of a netCDF classic file by name; only the header is read."""
    system, place = _opened(path)
    with system.open_input_file(place) as stream:
        head = _Header(stream)
        records = head.number()
        dims = [(head.text(), head.number()) for _ in head.listed(DIMENSIONS)]
        head.attributes()
        found = []
        for _ in head.listed(VARIABLES):
            name = head.text()
            ids = [head.number() for _ in range(head.number())]
            attributes, dtype = head.attributes(), np.dtype(TYPES[head.number(">i")])
            head.number()  # the size, which overflows for large variables: it follows from the shape
            found.append((name, ids, attributes, dtype, head.number(head._offset)))
        size = stream.size()
    lives = [bool(ids) and dims[ids[0]][1] == 0 for _, ids, *_ in found]
    bytes_of = lambda ids, dtype: math.prod(dims[i][1] for i in ids) * dtype.itemsize
    each = [bytes_of(ids[1:], dtype) for (_, ids, _, dtype, _), live in zip(found, lives) if live]
    step = each[0] if len(each) == 1 else sum(n + -n % 4 for n in each)
    first = min((begin for (*_, begin), live in zip(found, lives) if live), default=size)
    if records < 0:  # still being written: as many as the file holds
        records = (size - first) // step if step else 0
    return {name: Variable(name, [dims[i][0] for i in ids], [records if live and k == 0 else dims[i][1] for k, i in enumerate(ids)], dtype, begin, step if live else 0, attributes) for (name, ids, attributes, dtype, begin), live in zip(found, lives)}


def _meaning(values: np.ndarray, attributes: dict) -> np.ma.MaskedArray:
    """Values unpacked; fills, missing values and NaN are masked."""
    first = lambda k: np.ravel(attributes[k])[0] if k in attributes and not isinstance(attributes[k], str) else None
    hidden = np.isnan(values.astype(float))
    for name in ("_FillValue", "missing_value"):
        if first(name) is not None:
            hidden |= values == values.dtype.type(first(name))
    scale, offset = first("scale_factor"), first("add_offset")
    return np.ma.masked_array(values.astype(float) * (1.0 if scale is None else scale) + (0.0 if offset is None else offset), hidden)


class _Piece(InputPartition):
    """A box of cells: [low, high) of each dimension in the whole grid; `lead` is how far the file's first dimension is shifted."""

    def __init__(self, path: str, low: tuple[int, ...], high: tuple[int, ...], lead: int):
        super().__init__(None)
        self.path, self.low, self.high, self.lead = path, low, high, lead


class _Grid(DataSourceReader):
    def __init__(self, names: list[str], shape: list[int]):
        self.names, self.shape = names, shape
        self.window = [[0, n] for n in shape]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a dimension with a number narrow the window; Spark still applies all filters."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            numbers = value if isinstance(f, In) else (value,)
            if name in self.names and numbers and all(isinstance(v, int) for v in numbers):
                w = self.window[self.names.index(name)]
                if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual):
                    w[0] = max(w[0], min(numbers) + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | In | LessThan | LessThanOrEqual):
                    w[1] = min(w[1], max(numbers) + (not isinstance(f, LessThan)))
            yield f

    def _within(self, boxes: Iterator[_Piece]) -> list[_Piece]:
        return [b for b in boxes if all(max(lo, w[0]) < min(hi, w[1]) for lo, hi, w in zip(b.low, b.high, self.window))]

    def _rows(self, low: tuple[int, ...], values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A batch of a box that begins at `low`, cut to the window."""
        cut = [(max(lo, w[0]), min(lo + n, w[1])) for lo, n, w in zip(low, values.shape, self.window)]
        part = values[tuple(slice(a - lo, b - lo) for (a, b), lo in zip(cut, low))]
        at = np.meshgrid(*(np.arange(a, b) for a, b in cut), indexing="ij")
        hidden = np.ma.getmaskarray(part).ravel()
        columns = [pa.array(x.ravel(), pa.int64()) for x in at] + [pa.array(np.ma.getdata(part).ravel().astype(float), pa.float64(), mask=hidden)]
        yield pa.RecordBatch.from_arrays(columns, names=[*self.names, "value"])


class _NetcdfReader(_Grid):
    def __init__(self, paths: list[str], variable: str, run_bytes: int):
        self._files = [(p, netcdf_variables(p)[variable]) for p in sorted(paths)]
        first = self._files[0][1]
        if any(v.dimensions != first.dimensions or v.shape[1:] != first.shape[1:] for _, v in self._files):
            raise ValueError("the files' grids differ beyond their first dimension")
        if not first.shape:
            raise ValueError(f"{variable} has no dimensions")
        self._bytes, self._of = run_bytes, dict(self._files)
        super().__init__(first.dimensions, [sum(v.shape[0] for _, v in self._files), *first.shape[1:]])

    def partitions(self) -> list[_Piece]:
        def boxes() -> Iterator[_Piece]:
            lead = 0
            for path, v in self._files:
                run = max(1, self._bytes // max(1, math.prod(v.shape[1:]) * v.dtype.itemsize))
                for a in range(0, v.shape[0], run):
                    yield _Piece(path, (lead + a, *(0 for _ in v.shape[1:])), (lead + min(a + run, v.shape[0]), *v.shape[1:]), lead)
                lead += v.shape[0]

        return self._within(boxes())

    def read(self, piece: _Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # no partition is within the window
            return
        v = self._of[piece.path]
        a, b = max(piece.low[0], self.window[0][0]), min(piece.high[0], self.window[0][1])
        one = math.prod(v.shape[1:]) * v.dtype.itemsize
        step, begin = v.step or one, v.begin + (a - piece.lead) * (v.step or one)
        system, place = _opened(piece.path)
        with system.open_input_file(place) as stream:
            raw = stream.read_at(step * (b - a - 1) + one, begin)
        if len(raw) < step * (b - a - 1) + one:
            raise ValueError(f"{piece.path} ends within {v.name}")
        held = np.frombuffer(raw, np.uint8)
        rows = np.lib.stride_tricks.as_strided(held, (b - a, one), (step, 1)).copy()
        yield from self._rows((a, *piece.low[1:]), _meaning(rows.view(v.dtype).reshape(b - a, *v.shape[1:]), v.attributes))


class _ZarrReader(_Grid):
    def __init__(self, path: str):
        self._path = path.rstrip("/")
        system, place = _opened(f"{self._path}/zarr.json")
        with system.open_input_file(place) as stream:
            meta = json.loads(stream.read())
        if meta.get("zarr_format") != 3 or meta.get("node_type") != "array" or meta["chunk_grid"]["name"] != "regular":
            raise ValueError("not a zarr 3 array of regular chunks")
        encoding = meta["chunk_key_encoding"]
        self._prefix = encoding["name"] == "default"
        self._between = encoding.get("configuration", {}).get("separator", "/" if self._prefix else ".")
        self._chunk = meta["chunk_grid"]["configuration"]["chunk_shape"]
        self._codecs, self._fill = meta["codecs"], float(meta["fill_value"])
        for c in self._codecs:
            if c["name"] not in ("bytes", "gzip", "zstd"):
                raise ValueError(f"no such codec here: {c['name']}")
        order = "<" if next(c for c in self._codecs if c["name"] == "bytes").get("configuration", {}).get("endian", "little") == "little" else ">"
        self._dtype = np.dtype(meta["data_type"]).newbyteorder(order)
        names = meta.get("dimension_names") or [None] * len(meta["shape"])
        super().__init__([n or f"d{i}" for i, n in enumerate(names)], meta["shape"])

    def partitions(self) -> list[_Piece]:
        spans = [range(w[0] // c * c, max(w[1], 0), c) for w, c in zip(self.window, self._chunk)]
        return self._within(_Piece(self._path, low, tuple(min(a + c, n) for a, c, n in zip(low, self._chunk, self.shape)), 0) for low in itertools.product(*spans))

    def read(self, piece: _Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # no partition is within the window
            return
        at = [str(a // c) for a, c in zip(piece.low, self._chunk)]
        key = self._between.join((["c"] if self._prefix else []) + at)
        system, place = _opened(f"{piece.path}/{key}")
        if system.get_file_info(place).type == fs.FileType.NotFound:
            values = np.full(self._chunk, self._fill)
        else:
            with system.open_input_file(place) as stream:
                raw = stream.read()
            for c in reversed(self._codecs):
                if c["name"] == "gzip":
                    raw = gzip.decompress(raw)
                elif c["name"] == "zstd":
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            values = np.frombuffer(raw, self._dtype).reshape(self._chunk)
        yield from self._rows(piece.low, values[tuple(slice(0, hi - lo) for lo, hi in zip(piece.low, piece.high))])


class GridSource(DataSource):
    """spark.read.format("grid"): options `format` (netcdf or zarr), `paths` (a JSON list; several netCDF files follow one another along their
    first dimension, by name), `variable` (netcdf) and `run_bytes`. Columns: the place (from 0) in each dimension, and value.
    """

    @classmethod
    def name(cls) -> str:
        return "grid"

    def _grid(self) -> _Grid:
        paths = json.loads(self.options["paths"])
        if self.options["format"] == "zarr":
            return _ZarrReader(paths[0])
        return _NetcdfReader(paths, self.options["variable"], int(self.options.get("run_bytes", RUN_BYTES)))

    def schema(self) -> str:
        return ", ".join(f"`{n}` long" for n in self._grid().names) + ", value double"

    def reader(self, schema) -> DataSourceReader:
        return self._grid()


def _read(spark: SparkSession, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
    return spark.read.format("grid").options(**options).load()


def read_netcdf(spark: SparkSession, paths: str | list[str], variable: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(a column for each dimension, value) of a variable of netCDF classic files, those of several files along their first dimension.

    scale_factor and add_offset are applied; _FillValue, missing_value and NaN are null. Filters on dimensions choose what is read.
    """
    return _read(spark, format="netcdf", paths=json.dumps([paths] if isinstance(paths, str) else paths), variable=variable, run_bytes=str(run_bytes))


def read_zarr(spark: SparkSession, path: str) -> DataFrame:
    """(a column for each dimension, value) of a zarr 3 array; a chunk without a file holds the fill value. Filters on dimensions choose the chunks."""
    return _read(spark, format="zarr", paths=json.dumps([path]))


def time_of(units: str, value: Column) -> Column:
    """The timestamp of a time coordinate in units such as `hours since 1800-01-01 00:00:0.0` (standard calendar, UTC)."""
    found = re.fullmatch(r"\s*(day|hour|minute|second)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::([\d.]+))?)?\s*(?:UTC|Z)?\s*", units)
    if not found:
        raise ValueError(f"no such units of time: {units}")
    scale = {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}[found[1]]
    year, month, day, hour, minute = (int(x or 0) for x in found.groups()[1:6])
    base = F.unix_micros(F.to_timestamp(F.lit(f"{year:04d}-{month:02d}-{day:02d} {hour:02d}:{minute:02d}:00+00:00")))
    return F.timestamp_micros(base + F.round((value * scale + float(found[7] or 0)) * 1_000_000).cast("long"))


def write_zarr(df: DataFrame, path: str, columns: list[str], shape: list[int], chunk: list[int], codec: str = "zstd", fill: float = 0.0) -> None:
    """Write cells (columns, value) as a zarr 3 array of doubles, a task writing a chunk at a time under a name of its own before it gets its final one.

    A missing or null cell holds `fill`; a chunk without any cell gets no file. Of a cell given twice the largest value stays. Cells outside the
    shape are an error. The array's description is written last, so that an array that is there is whole.
    """
    bad = [(F.col(c) < 0) | (F.col(c) >= n) | F.col(c).isNull() for c, n in zip(columns, shape)]
    outside = bad[0]
    for b in bad[1:]:
        outside = outside | b
    part = [f"_k{i}" for i in range(len(columns))]
    cells = df.select(F.when(outside, F.raise_error(F.lit("a cell lies outside the grid"))).otherwise(F.col(columns[0])).cast("long").alias("_i0"), *(F.col(c).cast("long").alias(f"_i{i}") for i, c in enumerate(columns) if i), F.col("value").cast("double").alias("value"))
    placed = cells.select("*", *(F.floor(F.col(f"_i{i}") / n).alias(k) for i, (k, n) in enumerate(zip(part, chunk))))

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        block = np.full(chunk, fill)
        frame = frame.dropna(subset="value").sort_values("value")
        if not len(frame):
            return pd.DataFrame({"cells": [0]})
        block[tuple(frame[f"_i{i}"].to_numpy() % n for i, n in enumerate(chunk))] = frame["value"].to_numpy()
        raw = block.astype("<f8").tobytes()
        raw = gzip.compress(raw, 5, mtime=0) if codec == "gzip" else zstandard.compress(raw)
        system, place = _opened("/".join([path.rstrip("/"), "c", *(str(int(frame[k].iloc[0])) for k in part)]))
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        own = f"{place}.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as stream:
            stream.write(raw)
        system.move(own, place)
        return pd.DataFrame({"cells": [len(frame)]})

    placed.groupBy(*part).applyInPandas(write, "cells long").agg(F.sum("cells")).collect()
    config = {"level": 5} if codec == "gzip" else {"level": 3, "checksum": False}
    meta = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN" if fill != fill else fill, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": codec, "configuration": config}], "dimension_names": columns, "attributes": {}}
    system, place = _opened(f"{path.rstrip('/')}/zarr.json")
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as stream:
        stream.write(json.dumps(meta).encode())
