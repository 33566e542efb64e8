"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

write_archives() puts one gzip member for each record, members parted by one zero byte (padding that gzip allows),
through Spark's text writer, so that archives can be in any store. read_archives() checks each member (gzip CRC) and
record (version line, Content-Length, closing blank lines, block digest); after a failed check it searches for the next
gzip member or version line that holds a valid record, goes on from there, and logs the bytes between as a gap. Plain
(uncompressed) archives are read alike. A Content-Length is 1 to 18 decimal digits; a header of more than 64 KB, or with a version
line inside, is none. The next place of each mark is kept until it is passed, so junk is searched once.

Defined results: null html is an empty payload; a null page_id is written as such, is always a response and is referred to
by none; rows that repeat page_id and payload are all responses if that page_id is the largest; control characters in a URL are
percent-encoded; an empty table gives empty archives; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP, VERSION, BLANK_LINE = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
MOST_HEADER = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "file string, offset long, length long, ok boolean, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    start: int
    end: int


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, page_id: int | None, url: str, date: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP head and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Marks:
    """The next place of each mark in some bytes, for rising positions."""

    def __init__(self, data: bytes):
        self.data, self.places = data, {}

    def next(self, mark: bytes, at: int) -> int:
        """The mark's first place from `at` on; the length of the bytes if there is none."""
        asked, place = self.places.get(mark, (0, -1))
        if not asked <= at <= place:
            place = self.data.find(mark, at)
            place = len(self.data) if place < 0 else place
            self.places[mark] = at, place
        return place


def parse_record(data: bytes, start: int, marks: Marks | None = None) -> Record | None:
    """The record at `start`, or None if it fails a check."""
    if data[start : start + len(VERSION)] != VERSION:
        return None
    middle = (marks or Marks(data)).next(BLANK_LINE, start)
    if middle == len(data) or middle - start > MOST_HEADER or data.find(b"\n" + VERSION, start, middle) >= 0:
        return None
    try:
        lines = data[start:middle].decode("utf-8").split("\r\n")[1:]
    except UnicodeDecodeError:
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        return None
    end = middle + 4 + int(headers["content-length"])
    if data[end : end + 4] != BLANK_LINE:
        return None
    block = data[middle + 4 : end]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != base32_sha1(block):
        return None
    return Record(start, end + 4, headers, block)


def member(data: bytes, start: int, step: int = 1 << 16) -> tuple[bytes, int | None]:
    """(content, end) of the gzip member at `start`; of a damaged or cut one what inflates, and no end."""
    inflate, out, at = zlib.decompressobj(31), [], start
    while not inflate.eof and at < len(data):
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[at : at + step]))
        except zlib.error:
            for i in range(at, min(at + step, len(data))):  # byte by byte up to the damage
                try:
                    out.append(before.decompress(data[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), None
        at += step
    return b"".join(out), min(at, len(data)) - len(inflate.unused_data) if inflate.eof else None


def _records(content: bytes) -> tuple[list[Record], bool]:
    """(the valid records of a member's content, whether any of it is none)."""
    found, lost, at, marks = [], False, 0, Marks(content)
    while at < len(content):
        if r := parse_record(content, at, marks):
            found.append(r)
            at = r.end
        else:
            lost, at = True, marks.next(VERSION, at + 1)
    return found, lost


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of an archive in order, and the byte gaps between them that failed.

    A record inside a gzip member has the member's place; a member that holds anything but valid records gives those it holds and then a gap
    over the whole member. One whose end can't be found gives its records, and the gap goes to the next valid member or record.
    """
    at, lost, marks = 0, None, Marks(data)
    while at < len(data):
        if data[at] == 0 and lost is None:
            at += 1
            continue
        found, broken, end = [], False, None
        if data[at : at + 3] == GZIP:
            content, end = member(data, at)
            inner, broken = _records(content)
            found = [Record(at, at if end is None else end, r.headers, r.block) for r in inner]
            broken = broken or end is None
        elif r := parse_record(data, at, marks):
            found, end = [r], r.end
        if found and lost is not None:
            yield Gap(lost, at)
            lost = None
        yield from found
        if found and end is not None:
            if broken:
                yield Gap(at, end)
            at = end
            continue
        lost = at if lost is None else lost
        at = min(marks.next(GZIP, at + 1), marks.next(VERSION, at + 1))
    if lost is not None:
        yield Gap(lost, len(data))


def page_of(identifier: str | None) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", identifier or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000) -> None:
    """Write pages (page_id, url, html) to archives under path; of equal payloads of least_bytes or more, that with the largest page_id is the response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("response_id"))
    rows = rows.join(groups, "sha1", "left").select("page_id", "url", "payload", "sha1", "response_id")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page_id, url, payload, sha1, response in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                revisit = page_id is not None and response is not None and page_id != response
                data = record_bytes("revisit" if revisit else "response", page_id, url, date, payload, digest, len(payload), response)
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(deflate.compress(data) + deflate.flush())
                held += len(out[-1])
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = rows.mapInArrow(members, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each valid record (ok) and for each quarantined gap (not ok: file, offset and length alone).

    payload_bytes and payload_digest of a response are those of the payload read; a revisit's are what it states.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                out = []
                for found in salvage(content):
                    if isinstance(found, Gap):
                        out.append((file, found.start, found.end - found.start, False, None, None, None, None, None, None, None))
                        continue
                    headers = found.headers
                    head, _, payload = found.block.partition(b"\r\n\r\n")
                    kind = headers.get("warc-type")
                    size, digest = len(payload), base32_sha1(payload)
                    if kind == "revisit":
                        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                        size, digest = int(stated[1]) if stated else None, headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    out.append((file, found.start, found.end - found.start, True, page_of(headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), size, digest, page_of(headers.get("warc-refers-to")) if kind == "revisit" else None, payload if payloads else None))
                frame_out = pd.DataFrame(out, columns=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])
                for c in ("page_id", "payload_bytes", "refers_to"):
                    frame_out[c] = frame_out[c].astype("Int64")
                yield frame_out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD_SCHEMA)
