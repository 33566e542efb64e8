"""Readers and writers. Schemas are explicit; matrices become long tables at the boundary."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def read_attributes(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, one row with `dropped`) of a header-less CSV whose nulls are '?'."""
    schema = StructType([StructField(n, DoubleType()) for n in names])
    rows = spark.read.csv(path, header=False, nullValue="?", schema=schema, ignoreLeadingWhiteSpace=True)
    return rows.dropna(), rows.agg(F.count_if(F.greatest(*(F.col(n).isNull().cast("int") for n in names)) > 0).alias("dropped"))


def read_names(spark: SparkSession, path: str) -> list[str]:
    """The names on a file's one comma-separated line."""
    return [n.strip() for n in spark.read.text(path).first()[0].split(",")]


def read_matrix(spark: SparkSession, path: str, time: str | None = None) -> DataFrame:
    """(t, channel, value) of a header CSV with a row for each time; without a time column the row's place in the file is the time."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    if time is None:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("t", "line")).where("t > 0 AND line <> ''")
        cells = F.split("line", ",")
        names = F.array(*(F.lit(c) for c in wide.columns))
        return lines.select((F.col("t") - 1).cast("long").alias("t"), F.explode(F.arrays_zip(names.alias("channel"), cells.alias("value"))).alias("c")).select("t", "c.channel", F.col("c.value").try_cast("double").alias("value"))
    return wide.unpivot(time, [c for c in wide.columns if c != time], "channel", "value").withColumnRenamed(time, "t")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """(key, entity, value) of a CSV whose first column is the key and whose headers read `NAME (id)`; the first of repeated names stays."""
    wide = spark.read.csv(path, header=False, inferSchema=False)
    head = spark.read.text(path).first()[0].split(",")
    kept: dict[str, int] = {}
    for place, name in enumerate(head[1:], 1):
        kept.setdefault(name.split(" (")[0].strip('"'), place)
    rows = wide.where(F.col("_c0") != head[0]) if head[0] else wide.where(F.col("_c0").isNotNull())
    columns = [F.struct(F.lit(n).alias("entity"), F.col(f"_c{p}").try_cast("double").alias("value")) for n, p in kept.items()]
    return rows.select(F.col("_c0").alias("key"), F.explode(F.array(*columns)).alias("c")).select("key", "c.*")


def read_delimited(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = "\t") -> DataFrame:
    """Some columns of delimited files, with the file each row came from; the scan reads only those columns."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True).select(*columns, F.input_file_name().alias("file"))


def read_compatible(spark: SparkSession, paths: list[str], required: set[str]) -> DataFrame:
    """The union of those CSVs that have all required columns."""
    tables = [t for t in (spark.read.csv(p, header=True, inferSchema=True) for p in paths) if required <= set(t.columns)]
    if not tables:
        raise ValueError("no file has the required columns")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_arrays(spark: SparkSession, path: str, pattern: str = r"([A-Za-z]+)(-?[0-9.]+)") -> DataFrame:
    """(file, params, name, row, values) of .npy and .npz files; params are the name-number pairs in the file's name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                stem = re.sub(r"\.np[yz]$", "", file.rsplit("/", 1)[-1])
                params = {k: float(v.rstrip(".")) for k, v in re.findall(pattern, stem)}
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                arrays = {k: loaded[k] for k in loaded.files} if hasattr(loaded, "files") else {"": loaded}
                for name, a in arrays.items():
                    a = np.atleast_2d(np.asarray(a, float))
                    yield pd.DataFrame({"file": file, "params": [params] * len(a), "name": name, "row": np.arange(len(a)), "values": list(a)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, params map<string,double>, name string, row long, values array<double>")


def edf_signals(content: bytes) -> Iterator[tuple[str, float, np.ndarray]]:
    """(label, rate, physical values) of the signals that have the file's most common sampling rate."""
    count = int(content[252:256])
    field = lambda start, width: [content[256 + start * count + i * width : 256 + start * count + (i + 1) * width].decode("latin-1").strip() for i in range(count)]
    records, seconds = int(content[236:244]), float(content[244:252])
    labels, low, high, dlow, dhigh, samples = field(0, 16), *(np.array(field(s, 8), float) for s in (104, 112, 120, 128)), np.array(field(216, 8), int)
    data = np.frombuffer(content[256 * (count + 1) :], "<i2")
    records = records if records > 0 else len(data) // samples.sum()
    data = data[: records * samples.sum()].reshape(records, -1)
    rates, n = np.unique(samples, return_counts=True)
    common, starts = rates[n.argmax()], np.concatenate([[0], np.cumsum(samples)])
    for i in range(count):
        if samples[i] == common and dhigh[i] > dlow[i]:
            raw = data[:, starts[i] : starts[i + 1]].ravel().astype(float)
            yield labels[i], common / seconds, (raw - dlow[i]) * (high[i] - low[i]) / (dhigh[i] - dlow[i]) + low[i]


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """(file, channel, rate, block, values): signals in blocks of 4096 samples, a row each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                for label, rate, values in edf_signals(content):
                    blocks = [values[i : i + 4096] for i in range(0, len(values), 4096)]
                    yield pd.DataFrame({"file": file, "channel": label, "rate": rate, "block": np.arange(len(blocks)), "values": blocks})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, channel string, rate double, block long, values array<double>")


def read_recording_json(spark: SparkSession, path: str, traces: str, labels: str) -> DataFrame:
    """(t, channel, label, value) of a (compressed) JSON recording: `traces` channels by time, `labels` a map from channel number."""
    rows = spark.read.json(path, multiLine=True, schema=f"{traces} array<array<double>>, {labels} map<string,string>")
    long = rows.select(F.posexplode(traces).alias("channel", "x"), F.col(labels).alias("l")).select("channel", "l", F.posexplode("x").alias("t", "value"))
    return long.select(F.col("t").cast("long").alias("t"), F.col("channel").cast("string").alias("channel"), F.try_element_at("l", F.col("channel").cast("string")).alias("label"), "value")


def read_probe_matrix(spark: SparkSession, path: str, probes: DataFrame) -> DataFrame:
    """(gene, sample, value) of a GEO series matrix, probes (probe, gene) averaged by gene; header lines start with '!'."""
    lines = spark.read.text(path).where(~F.col("value").startswith("!") & (F.col("value") != ""))
    cells = lines.select(F.transform(F.split("value", "\t"), lambda x: F.translate(x, '"', "")).alias("c"))
    head = cells.where(F.col("c")[0] == "ID_REF").select(F.posexplode("c").alias("i", "sample")).where("i > 0")
    body = cells.where(F.col("c")[0] != "ID_REF").select(F.col("c")[0].alias("probe"), F.posexplode("c").alias("i", "x")).where("i > 0")
    return body.join(probes, "probe").join(F.broadcast(head), "i").groupBy("gene", "sample").agg(F.avg(F.col("x").try_cast("double")).alias("value"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(record, start_s, end_s) of seizure summaries: files named, then start and end seconds in order."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(File Name:.*?)(?=File Name:|\z)"), 1)).alias("b"))
    record = F.trim(F.regexp_extract("b", r"File Name:\s*(\S+)", 1))
    starts = F.regexp_extract_all("b", F.lit(r"Start Time:\s*([0-9]+) seconds"), 1)
    ends = F.regexp_extract_all("b", F.lit(r"End Time:\s*([0-9]+) seconds"), 1)
    return blocks.select(record.alias("record"), F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("x")).select("record", F.col("x.s").cast("double").alias("start_s"), F.col("x.e").cast("double").alias("end_s"))


def column_like(df: DataFrame, *parts: str) -> str:
    """The first column whose name holds one of the parts."""
    for part in parts:
        for c in df.columns:
            if part.lower() in c.lower():
                return c
    raise ValueError(f"no column holds any of {parts}")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the Parquet table at `path` lacks, so that a stopped job goes on where it was."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        df = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, order: list, kind: str = "csv") -> None:
    """A report-sized table in order as one CSV or JSON file."""
    writer = df.orderBy(*order).coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)
