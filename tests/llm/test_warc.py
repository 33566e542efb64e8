import gzip
import random
import time

import pytest

from quillon.llm import warc
from quillon.llm.runtime import scratch


def record(i, payload=b"payload"):
    return warc.record_bytes("response", i, "http://x.example/", "2024-01-01T00:00:00Z", payload, warc.base32_sha1(payload), len(payload), None)


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\n a", "".join(rng.choices("aé中\0\x1f\x8b\r\n<", k=rng.randint(0, 3000))), "c") for i in range(60)]
    rows += [(100, "u", None, "c"), (101, None, "", "c"), (102, "u", "same", "c"), (90, "u", "same", "c"), (91, "u", "same", "c"), (102, "u", "same", "c"), (None, "u", "same", "c"), (200, "u", "long " * 300_000, "c")]
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string"), path, records_per_file=7)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert all(r.ok for r in got) and len(got) == len(rows)
    largest = {}
    for i, _, html, _ in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", -1), i)
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        revisit = i is not None and largest[html or ""] != i
        want.append((str(i), len(data), warc.base32_sha1(data), "revisit" if revisit else "response", str(largest[html or ""] if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert all(bytes(r.payload) == (dict((x[0], x[2]) for x in rows)[r.page_id] or "").encode() for r in got if r.record_type == "response" and r.page_id is not None)


def test_empty_table(spark):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_salvage_of_damaged_members():
    members = [gzip.compress(record(i, bytes([65 + i]) * 500), mtime=0) for i in range(5)]
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + members[1] + bytes(broken) + members[3] + b"junk" + members[4]
    found = [*warc.salvage(data)]
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)] == [0, 1, 3, 4]
    start = len(members[0] + members[1])
    assert [g for g in found if isinstance(g, warc.Gap)] == [warc.Gap(start, start + len(broken)), warc.Gap(start + len(broken) + len(members[3]), len(data) - len(members[4]))]


def test_salvage_of_plain_records():
    parts = [record(i) for i in range(4)]
    wrong = parts[1].replace(b"Content-Length: 8", b"Content-Length: 9", 1).replace(b"payload\r\n", b"pAyload\r\n")
    data = parts[0] + wrong + parts[2] + parts[3][:-30]
    found = [*warc.salvage(data)]
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)] == [0, 2]
    gaps = [g for g in found if isinstance(g, warc.Gap)]
    assert gaps[0] == warc.Gap(len(parts[0]), len(parts[0] + wrong)) and gaps[-1].end == len(data)


def test_salvage_inside_members():
    rng = random.Random(2)
    parts = [record(i, bytes(rng.randrange(256) for _ in range(3000))) for i in range(6)]
    wrong = parts[1].replace(b"WARC-Payload", b"WARC-PayloaD", 1)[:-5] + b"x\r\n\r\n"
    one = gzip.compress(parts[0] + wrong + parts[2], mtime=0)
    cut = bytearray(gzip.compress(parts[3] + parts[4], mtime=0))
    cut[-100] ^= 0xFF  # the last record's bytes; the ones before still inflate
    data = one + bytes(cut) + gzip.compress(parts[5], mtime=0)
    found = [*warc.salvage(data)]
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)] == [0, 2, 3, 5]
    assert [g for g in found if isinstance(g, warc.Gap)] == [warc.Gap(0, len(one)), warc.Gap(len(one), len(one) + len(cut))]


@pytest.mark.parametrize("length", ["-4", "-1", "+8", "1_0", "", "9" * 30, "99999999", "0x8", " "])
def test_damaged_lengths_end(length):
    parts = [record(i) for i in range(3)]
    size = len(parts[1].split(b"\r\n\r\n", 1)[1]) - 4
    wrong = parts[1].replace(b"Content-Length: %d\r\n\r\n" % size, b"Content-Length: " + length.encode() + b"\r\n\r\n", 1)
    found = [*warc.salvage(parts[0] + wrong + parts[2])]
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)] == [0, 2]
    assert [g for g in found if isinstance(g, warc.Gap)] == [warc.Gap(len(parts[0]), len(parts[0] + wrong))]
    inner = [*warc.salvage(gzip.compress(parts[0] + wrong + parts[2], mtime=0))]
    assert [warc.page_of(r.headers["warc-record-id"]) for r in inner if isinstance(r, warc.Record)] == [0, 2]


def test_a_length_that_points_back_before_the_record():
    back = b"\r\n\r\nWARC/1.1\r\nContent-Length: -33\r\n\r\n"
    found = [*warc.salvage(record(1) + back + record(2))]
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)] == [1, 2]


@pytest.mark.parametrize("junk", [b"WARC/1.1\r\n", b"WARC/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n", b"WARC/1." + b"x" * 50])
def test_junk_is_searched_once(junk):
    began = time.time()
    found = [*warc.salvage(record(1) + junk * (8_000_000 // len(junk)) + b"\r\n\r\n" + record(2))]
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)] == [1, 2]
    assert time.time() - began < 30


def test_a_member_cut_at_every_byte():
    first, last = gzip.compress(record(1), mtime=0), gzip.compress(record(3), mtime=0)
    middle = gzip.compress(record(2), mtime=0)
    for cut in range(len(middle)):
        found = [*warc.salvage(first + middle[:cut] + last)]
        ids = [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)]
        assert ids in ([1, 3], [1, 2, 3])
