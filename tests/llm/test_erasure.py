import collections
import hashlib
import math
import os
import zlib

import pyarrow.parquet as pq
import pytest

from quillon.llm.erasure import erase_clients
from quillon.llm.registry import op11_erasure
from quillon.llm.runtime import scratch

SF = "/root/testdata/sf0.001"
MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def brute(tables, files=250, modulus=200):
    """{(table, file_no): (ids, n_erased, cents, rewritten)} of the files that stay."""
    buyer = {}
    for s in tables["sales"]:
        if None not in (s["client_id"], s["sale_id"]):
            buyer[s["sale_id"]] = min(s["client_id"], buyer.get(s["sale_id"], s["client_id"]))
    clicks = collections.Counter(c["client_id"] for c in tables["clicks"] if c["client_id"] is not None)
    own = collections.defaultdict(set)
    for c in tables["clients"]:
        if c["master_id"] is not None:
            own[c["master_id"]].add(c["client_id"])
    masters = {m for m in own if crc(m) % modulus == 0}
    if own:
        masters.add(min(own, key=lambda m: (-sum(clicks[c] for c in own[m]), m)))
    gone = {c["client_id"] for c in tables["clients"] if c["master_id"] in masters} - {None}
    sold = {s["sale_id"] for s in tables["sales"] if s["client_id"] in gone} - {None}
    victim = {"clients": lambda r: r["master_id"] in masters, "clicks": lambda r: r["client_id"] in gone, "sales": lambda r: r["client_id"] in gone, "sale_lines": lambda r: r["sale_id"] in sold}
    out = {}
    for name, rows in tables.items():
        key = (lambda r: crc(buyer.get(r["sale_id"]))) if name == "sale_lines" else lambda r: crc(r["client_id"])
        rows = sorted(rows, key=lambda r: (key(r), *((v is not None, v) for v in r.values())))
        per = 1 + len(rows) // files
        for f in range(0, len(rows), per):
            stay = [r for r in rows[f : f + per] if not victim[name](r)]
            n = len(rows[f : f + per])
            if stay:
                first = next(iter(stay[0]))
                money = sum(math.floor(100 * r[MONEY[name]] + 0.5) for r in stay if r[MONEY[name]] is not None)
                out[name, f // per] = ([r[first] for r in stay], n - len(stay), money, len(stay) < n)
    return out


def compare(got, want):
    assert {(r.table_name, r.file_no) for r in got} == set(want)
    for r in got:
        ids, erased, cents, rewritten = want[r.table_name, r.file_no]
        digest = hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
        assert (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256) == (len(ids), erased, cents, rewritten, digest)
        file = pq.ParquetFile(r.path)
        assert r.columns == ",".join(file.schema_arrow.names)
        assert file.read().column(0).to_pylist() == ids
        whole, groups = [i for i in ids if i is not None], [file.metadata.row_group(g).column(0) for g in range(file.num_row_groups)]
        if whole:
            assert min(g.statistics.min for g in groups if g.statistics.has_min_max) == min(whole) and max(g.statistics.max for g in groups if g.statistics.has_min_max) == max(whole)


def only_these(got):
    folder = os.path.commonpath([r.path for r in got])
    folder = folder[: folder.index("erasure-") + len("erasure-") + 32]
    found = {os.path.join(d, x) for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet")}
    assert found == {r.path for r in got}


def test_query_equals_brute_force(spark):
    tables = {t: pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in MONEY}
    got = op11_erasure(spark, SF).collect()
    compare(got, brute(tables))
    only_these(got)
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)


SCHEMAS = {
    "clients": "client_id long, master_id long, file_no string, balance double",
    "clicks": "click_id long, client_id long, value double, place string",
    "sales": "sale_id long, client_id long, total double, rank int",
    "sale_lines": "sale_id long, line_no int, amount double, buyer string, `a.b` string",
}


def frames(spark, tables):
    return [spark.createDataFrame([tuple(r.values()) for r in tables[t]], SCHEMAS[t]) for t in MONEY]


def named(**rows):
    names = {"clients": ["client_id", "master_id", "file_no", "balance"], "clicks": ["click_id", "client_id", "value", "place"], "sales": ["sale_id", "client_id", "total", "rank"], "sale_lines": ["sale_id", "line_no", "amount", "buyer", "a.b"]}
    return {t: [dict(zip(names[t], r)) for r in rows[t]] for t in MONEY}


@pytest.mark.parametrize("files", [250, 3])
def test_odd_rows(spark, files):
    tables = named(
        clients=[(1, 1, "x", 1.005), (2, 1, None, None), (3, 2, "é", -0.5), (4, None, "y", 2.0), (None, 1, "z", 3.0), (None, 3, "z", 3.0), (None, None, None, None), (5, 5, "t", 7.25), (5, 5, "t", 7.25)],
        clicks=[(i, [1, 1, 1, 2, 3, None, 9, 5][i % 8], [None, 0.125, 2.5][i % 3], "p" * (i % 4)) for i in range(60)] + [(None, 1, 1.0, None), (None, None, None, None)],
        sales=[(1, 1, 5.0, 1), (2, 3, 6.0, None), (3, None, 7.0, 2), (4, 2, None, 3), (None, 1, 1.0, 1), (6, 99, 1.0, 1), (7, 3, 1.0, 0), (7, 1, 1.0, 0)],
        sale_lines=[(s, i, 1.5 * i, "b", "c") for i in range(5) for s in (1, 2, 3, 4, 6, 7, 8, None)] * 2,
    )
    got = erase_clients(*frames(spark, tables), scratch(spark, "erasure"), files).collect()
    compare(got, brute(tables, files))
    only_these(got)


def test_a_hot_client_and_ties(spark):
    tables = named(
        clients=[(i, i, "c", 1.0) for i in range(40)],
        clicks=[(i, 7 if i % 3 == 0 else i % 40, 1.0, "w") for i in range(900)],
        sales=[(i, 7 if i % 3 == 0 else i % 40, 2.0, 0) for i in range(300)],
        sale_lines=[(0, 0, 3.0, "same", "same")] * 500 + [(i % 300, i, 1.0, "l", "m") for i in range(500)],
    )
    compare(erase_clients(*frames(spark, tables), scratch(spark, "erasure"), 20).collect(), brute(tables, 20))
    tables["clicks"] = []  # every master has 0 clicks: the smallest goes
    compare(erase_clients(*frames(spark, tables), scratch(spark, "erasure"), 20).collect(), brute(tables, 20))


def test_all_rows_go_and_empty_tables(spark):
    tables = named(clients=[(1, 1, "a", 1.0)], clicks=[(1, 1, 1.0, "a")] * 600, sales=[(1, 1, 1.0, 1)], sale_lines=[(1, 1, 1.0, "a", "b")])
    assert erase_clients(*frames(spark, tables), scratch(spark, "erasure"), 20).collect() == []
    empty = [f.limit(0) for f in frames(spark, tables)]
    assert erase_clients(*empty, scratch(spark, "erasure"), 20).collect() == []
    kept = erase_clients(empty[0], *frames(spark, tables)[1:], scratch(spark, "erasure"), 20).collect()
    assert sum(r.n_rows for r in kept) == 602 and not any(r.rewritten for r in kept)
