"""Cascading erasure: the rows of some clients, and all that hangs on them, leave tables of large sorted files.

While a table is laid out in files of consecutive rows, an inverted index is written beside it: for each client or sale key the
runs of file numbers that hold it. To erase, the victims of one table are joined with the postings of the next, which names the
files to open; only these are read, filtered and written anew in place (dynamic partition overwrite), and files that lost all rows
are removed. The cascade goes master -> clients -> clicks and sales -> sale_lines, and reads victims from opened files only.

A table is sorted once by Spark's range partitioning over all its columns, so rows of one hot key still go to many tasks; ranks are
places in the sorted partitions plus the partitions' offsets. A file is written by one task, which streams it. The driver sees
numbers of files and partitions, never keys or rows.

Defined results: rows with a null key are nobody's and stay, but clients without client_id go with their master; repeated rows
are laid out and erased each; of several sales rows with one sale_id the smallest client_id orders its lines, and the lines go if
any of them is a victim; an empty table has no files; columns may have any name, types must be orderable (no maps).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import bounded, free_name, scratch, stored

#: A table of n rows is laid out in files of 1 + floor(n / FILES) rows.
FILES = 250
_PLACE = (1 << 33) - 1  # monotonically_increasing_id() holds a row's place below its partition


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Laid:
    """A table in files of consecutive rows, with the postings of one key."""

    name: str
    path: str
    schema: T.StructType
    part: str  # the partition column, which has the file's number
    rows: int
    per_file: int
    key: str
    postings: DataFrame  # key, first_file, last_file

    @property
    def files(self) -> int:
        return -(-self.rows // self.per_file)

    def size_of(self, file_no: int) -> int:
        return min(self.per_file, self.rows - file_no * self.per_file)

    def read(self, files: list[int] | None = None) -> DataFrame:
        """The rows of all files or of these only, with the file's number."""
        fields = T.StructType([*self.schema.fields, T.StructField(self.part, T.LongType())])
        out = self.postings.sparkSession.read.schema(fields).parquet(self.path)
        return out if files is None else out.where(col(self.part).isin(files))

    def paths(self) -> dict[int, str]:
        """The present files by number."""
        found = [(re.search(rf"/{re.escape(self.part)}=(\d+)/", unquote(p)), p) for p in self.read().inputFiles()] if self.rows else []
        return {int(m[1]): p for m, p in found}


def _write(rows: DataFrame, laid_part: str, place: str, files: int, path: str, fresh: bool) -> None:
    """Rows to one file for each number, in the order of `place`; each file by one task."""
    rows = rows.repartitionById(max(1, files), col(laid_part).cast("int")).sortWithinPartitions(col(laid_part), col(place)).drop(place)
    writer = rows.write.partitionBy(laid_part)
    (writer if fresh else writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")).parquet(path)


def lay_out(name: str, rows: DataFrame, order: Column, key: str, folder: str, files: int = FILES, columns: list[str] | None = None) -> Laid:
    """`rows` sorted by `order`, then `columns` (all, unless named) left to right, in files of 1 + floor(n / files) rows, and the postings of `key`."""
    spark, columns = rows.sparkSession, columns or rows.columns
    part, at, first, rank = (free_name(n, rows) for n in ("file_no", "at", "first", "rank"))
    ordered = rows.withColumn(first, order).orderBy(first, *[col(c) for c in columns]).select(*[col(c) for c in columns]).withColumn(at, F.monotonically_increasing_id())
    ordered = stored(ordered, f"ordered-{name}")
    parts = sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright(at, 33)).count().collect())
    starts, total = [], 0
    for p, n in parts:
        starts.append((p, total))
        total += n
    per_file = 1 + total // files
    offsets = F.broadcast(spark.createDataFrame(starts, "_p long, _start long"))  # a row for each partition
    ranks = ordered.join(offsets, F.shiftright(at, 33) == F.col("_p")).withColumn(rank, F.col("_start") + col(at).bitwiseAND(F.lit(_PLACE))).drop("_p", "_start", at)
    numbered = ranks.withColumn(part, F.expr(f"`{rank}` div {per_file}"))
    held = numbered.select(col(key).alias("key"), col(part).alias("file")).distinct()
    island = held.withColumn("island", F.col("file") - F.row_number().over(Window.partitionBy("key").orderBy("file")))
    postings = stored(island.groupBy("key", "island").agg(F.min("file").alias("first_file"), F.max("file").alias("last_file")).drop("island"), f"postings-{name}")
    _write(numbered, part, rank, -(-total // per_file), f"{folder}/{name}", True)
    return Laid(name, f"{folder}/{name}", rows.select(*[col(c) for c in columns]).schema, part, total, per_file, key, postings)


def files_holding(laid: Laid, victims: DataFrame) -> list[int]:
    """The numbers of the files that hold a key of `victims` (one column, `key`): at most as many as there are files."""
    runs = laid.postings.join(victims, "key", "left_semi")
    return sorted(r[0] for r in runs.select(F.explode(F.sequence("first_file", "last_file"))).distinct().collect())


def rewrite(laid: Laid, files: list[int], victims: DataFrame) -> None:
    """These files without the rows whose key is in `victims`; a file without survivors is removed."""
    if not files:
        return
    before, spark, place = laid.paths(), victims.sparkSession, free_name("place", laid.read())
    gone = victims.select(F.col("key").alias(laid.key))
    survivors = laid.read(files).withColumn(place, F.col("_metadata.row_index")).join(gone, laid.key, "left_anti")
    _write(survivors.select(*[col(c) for c in laid.schema.names], col(laid.part), place), laid.part, place, laid.files, laid.path, False)
    after = laid.paths()
    for f in files:
        if before[f] == after.get(f):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{laid.path}/{laid.part}={f}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5); null and what is no finite number count 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e15)
    return F.when(finite, F.floor(100 * x + 0.5)).otherwise(0).cast("long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of one slot: rows, cents, SHA-256 of the comma-joined ids; a file's ids are never held together."""
    slot, n, total, sha = None, 0, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([sha.hexdigest()])], ["slot", "n_rows", "cents", "ids_sha256"])

    for batch in batches:
        slots, ids, money = (batch.column(i).to_pylist() for i in range(3))
        begin = 0
        while begin < len(slots):
            end = begin
            while end < len(slots) and slots[end] == slots[begin]:
                end += 1
            if slots[begin] != slot:
                if slot is not None:
                    yield row()
                slot, n, total, sha = slots[begin], 0, 0, hashlib.sha256()
            sha.update((("," if n else "") + ",".join(ids[begin:end])).encode())
            n, total, begin = n + end - begin, total + sum(money[begin:end]), end
    if slot is not None:
        yield row()


def report(spark: SparkSession, tables: list[tuple[Laid, list[int], str]]) -> DataFrame:
    """A row for each present file of (table, files that held victims, column of money)."""
    names, frames, base = [], [], 0
    for laid, files, money in tables:
        for f, path in laid.paths().items():
            names.append((base + f, f, laid.size_of(f), f in set(files), laid.name, ",".join(laid.schema.names), unquote(re.sub("^file:/*", "/", path))))
        first = F.coalesce(col(laid.schema.names[0]).cast("string"), F.lit(""))
        frames.append(laid.read().select((base + col(laid.part)).alias("slot"), F.col("_metadata.row_index").alias("place"), first.alias("id"), cents(col(money)).alias("cents")))
        base += laid.files
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other)
    streams = rows.repartition("slot").sortWithinPartitions("slot", "place").select("slot", "id", "cents")
    digests = streams.mapInArrow(_digests, "slot long, n_rows long, cents long, ids_sha256 string")
    listing = spark.createDataFrame(names, "slot long, file_no long, laid long, rewritten boolean, table_name string, columns string, path string")
    return digests.join(F.broadcast(listing), "slot").select("file_no", "n_rows", (F.col("laid") - F.col("n_rows")).alias("n_erased"), "cents", "rewritten", "table_name", "ids_sha256", "columns", "path")


def victim_masters(clients: DataFrame, clicks: DataFrame, modulus: int = 200) -> DataFrame:
    """key: masters whose number's CRC-32 is divisible by `modulus`, and the one whose clients have most clicks (ties: the smallest)."""
    own = clients.where(F.col("master_id").isNotNull()).select(F.col("master_id").alias("key"), "client_id").distinct()
    visits = clicks.groupBy("client_id").agg(F.count("*").alias("n"))
    loudest = own.join(visits, "client_id", "left").groupBy("key").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).orderBy(F.desc("n"), "key").limit(1).select("key")
    drawn = own.select("key").where(F.crc32(F.col("key").cast("string")) % modulus == 0)
    return stored(drawn.union(loudest).distinct(), "victim-masters")


def erase_clients(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, folder: str, files: int = FILES, modulus: int = 200) -> DataFrame:
    """Lay the four tables out in `folder`, erase the victim masters' clients with their clicks, sales and lines, report the final files."""
    spark = clients.sparkSession

    def by_client(name: str = "client_id") -> Column:
        return F.crc32(F.coalesce(col(name).cast("string"), F.lit("")))

    def keys(laid: Laid, files: list[int], victims: DataFrame, wanted: str) -> DataFrame:
        """What the victims of a laid table pass on, read from the opened files only."""
        rows = laid.read(files).join(victims.select(F.col("key").alias(laid.key)), laid.key, "left_semi")
        return stored(rows.where(col(wanted).isNotNull()).select(col(wanted).alias("key")).distinct(), f"victims-{wanted}")

    buyer, sale = free_name("buyer", sale_lines), free_name("of_sale", sale_lines)
    buyers = sales.where(F.col("sale_id").isNotNull()).groupBy(F.col("sale_id").alias(sale)).agg(F.min("client_id").alias(buyer))
    buyers = stored(buyers, "buyers")  # so that both sides of the join are plain exchanges, which adaptive execution can split at a hot sale
    lines = sale_lines.join(buyers, F.col("sale_id") == F.col(sale), "left").select(*[col(c) for c in sale_lines.columns], by_client(buyer).alias(buyer))
    masters = victim_masters(clients, clicks, modulus)
    laid_clients = lay_out("clients", clients, by_client(), "master_id", folder, files)
    laid_clicks = lay_out("clicks", clicks, by_client(), "client_id", folder, files)
    laid_sales = lay_out("sales", sales, by_client(), "client_id", folder, files)
    laid_lines = lay_out("sale_lines", lines, col(buyer), "sale_id", folder, files, sale_lines.columns)
    steps = []
    held = files_holding(laid_clients, masters)
    victims = keys(laid_clients, held, masters, "client_id")
    steps.append((laid_clients, held, masters, "balance"))
    steps.append((laid_clicks, files_holding(laid_clicks, victims), victims, "value"))
    held = files_holding(laid_sales, victims)
    sold = keys(laid_sales, held, victims, "sale_id")
    steps.append((laid_sales, held, victims, "total"))
    steps.append((laid_lines, files_holding(laid_lines, sold), sold, "amount"))
    for laid, opened, gone, _ in steps:
        rewrite(laid, opened, bounded(gone))
    return report(spark, [(laid, opened, money) for laid, opened, _, money in steps])


def erasure_folder(spark: SparkSession) -> str:
    return scratch(spark, "erasure")
