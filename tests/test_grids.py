"""Gridded arrays: round trips, windows, headers of all classic versions."""

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import grids

NUMBERS = {"S1": 2, ">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6, ">i8": 10}


def netcdf(dims, variables, records, version=1):
    """Bytes of a classic file; variables: (name, dimension numbers, attributes, array). A dimension of length 0 has the records."""
    count, place = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(count, len(s)) + pad(s.encode())
    listed = lambda tag, items: struct.pack(">i", tag if items else 0) + struct.pack(count, len(items)) + b"".join(items)

    def attribute(name, value):
        a = np.frombuffer(value.encode(), "S1") if isinstance(value, str) else np.atleast_1d(value)
        return text(name) + struct.pack(">i", NUMBERS[a.dtype.str.replace("|", "")]) + struct.pack(count, a.size) + pad(a.tobytes())

    live = [bool(d) and dims[d[0]][1] == 0 for _, d, _, _ in variables]
    size = lambda v, l: v[3].nbytes // (records or 1) if l else v[3].nbytes
    alone = sum(live) == 1
    padded = lambda n, l: n if l and alone else n + -n % 4

    def header(begins):
        made = [text(n) + struct.pack(count, len(d)) + b"".join(struct.pack(count, i) for i in d) + listed(12, [attribute(*a) for a in at.items()]) + struct.pack(">i", NUMBERS[x.dtype.str.replace("|", "")]) + struct.pack(count, size(v, l)) + struct.pack(place, b) for v, l, b in zip(variables, live, begins) for n, d, at, x in [v]]
        return b"CDF" + bytes([version]) + struct.pack(count, records) + listed(10, [text(n) + struct.pack(count, k) for n, k in dims]) + listed(12, [attribute("title", "a test")]) + listed(11, made)

    at, begins = len(header([0] * len(variables))), [0] * len(variables)
    for wanted in (False, True):
        for i, (v, l) in enumerate(zip(variables, live)):
            if l is wanted:
                begins[i], at = at, at + padded(size(v, l), l)
    out = header(begins) + b"".join(pad(v[3].tobytes()) for v, l in zip(variables, live) if not l)
    for r in range(records):
        for v, l in zip(variables, live):
            if l:
                b = v[3][r].tobytes()
                out += b + b"\0" * (padded(len(b), True) - len(b))
    return out


def dense(frame, shape, names):
    out = np.full(shape, np.nan)
    for r in frame.collect():
        out[tuple(r[n] for n in names)] = np.nan if r["value"] is None else r["value"]
    return out


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("several", [False, True])
def test_netcdf_round_trip(spark, tmp_path, version, several):
    rng = np.random.default_rng(version)
    packed = rng.integers(-900, 900, (7, 3, 5)).astype(">i2")
    packed[2, 1, 3] = -999
    lat = np.array([10, 20, 30], ">f4")
    slp = ("slp", [0, 1, 2], {"scale_factor": np.array([0.5], ">f8"), "add_offset": np.array([100.0], ">f8"), "_FillValue": np.array([-999], ">i2"), "units": "hPa"}, packed)
    time = [("time", [0], {"units": "hours since 1800-01-01 00:00:0.0"}, np.arange(7).astype(">f8"))] if several else []
    (tmp_path / "a.nc").write_bytes(netcdf([("time", 0), ("lat", 3), ("lon", 5)], [("lat", [1], {}, lat), slp, *time], 7, version))
    path = str(tmp_path / "a.nc")
    names = ["time", "lat", "lon"]
    want = packed * 0.5 + 100.0
    want[2, 1, 3] = np.nan
    got = grids.read_netcdf(spark, path, "slp", run_bytes=60)
    assert got.columns == [*names, "value"] and got.rdd.getNumPartitions() == 4
    np.testing.assert_array_equal(dense(got, want.shape, names), want)
    assert [r["value"] for r in grids.read_netcdf(spark, path, "lat").orderBy("lat").collect()] == [10, 20, 30]
    window = got.where("time >= 3 AND time < 5 AND lat = 1")
    assert window.rdd.getNumPartitions() == 2 and window.count() == 10
    assert grids.netcdf_variables(path)["slp"].attributes["units"] == "hPa"


def test_years_follow_one_another(spark, tmp_path):
    parts = [(np.arange(n * 2).reshape(n, 2) + 100 * i).astype(">f4") for i, n in enumerate((3, 1, 4))]
    for i, x in enumerate(parts):
        (tmp_path / f"slp.{1948 + i}.nc").write_bytes(netcdf([("time", 0), ("cell", 2)], [("slp", [0, 1], {}, x)], len(x)))
    paths = [str(tmp_path / f"slp.{y}.nc") for y in (1950, 1948, 1949)]
    got = grids.read_netcdf(spark, paths, "slp")
    np.testing.assert_array_equal(dense(got, (8, 2), ["time", "cell"]), np.concatenate(parts))
    assert [r["value"] for r in got.where("time = 3").orderBy("cell").collect()] == [100, 101] and got.where("time IN (0, 3)").rdd.getNumPartitions() == 2
    (tmp_path / "slp.1951.nc").write_bytes(netcdf([("time", 0), ("cell", 3)], [("slp", [0, 1], {}, np.zeros((1, 3), ">f4"))], 1))
    with pytest.raises(Exception, match="differ"):
        grids.read_netcdf(spark, [*paths, str(tmp_path / "slp.1951.nc")], "slp").count()


def test_damaged_files(spark, tmp_path):
    whole = netcdf([("t", 0), ("c", 2)], [("v", [0, 1], {}, np.ones((5, 2), ">f8"))], 5)
    (tmp_path / "cut.nc").write_bytes(whole[:-8])
    (tmp_path / "other.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(Exception, match="ends within"):
        grids.read_netcdf(spark, str(tmp_path / "cut.nc"), "v").count()
    with pytest.raises(Exception, match="not a netCDF"):
        grids.read_netcdf(spark, str(tmp_path / "other.nc"), "v").count()
    (tmp_path / "none.nc").write_bytes(netcdf([("t", 0), ("c", 2)], [("v", [0, 1], {}, np.ones((0, 2), ">f8"))], 0))
    assert grids.read_netcdf(spark, str(tmp_path / "none.nc"), "v").count() == 0


@pytest.mark.parametrize("codec", ["zstd", "gzip"])
def test_zarr_round_trip(spark, tmp_path, codec):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(23, 7)).round(3)
    x[10:20, :4] = -1.0  # a chunk without cells
    cells = [(i, j, float(x[i, j])) for i in range(23) for j in range(7) if x[i, j] != -1.0]
    frame = spark.createDataFrame([*cells, (12, 1, None), (0, 0, -50.0)], "t long, c long, value double")
    path = str(tmp_path / "grid")
    grids.write_zarr(frame, path, ["t", "c"], [23, 7], [10, 4], codec, fill=-1.0)
    x[0, 0] = max(x[0, 0], -50.0)
    files = sorted(str(p.relative_to(path)) for p in (tmp_path / "grid").rglob("*") if p.is_file())
    assert files == ["c/0/0", "c/0/1", "c/1/1", "c/2/0", "c/2/1", "zarr.json"]
    got = grids.read_zarr(spark, path)
    np.testing.assert_array_equal(dense(got, x.shape, ["t", "c"]), x)
    window = got.where("t > 9 AND t <= 20 AND c < 4")
    assert got.rdd.getNumPartitions() == 6 and window.rdd.getNumPartitions() == 2
    assert window.count() == 44 and window.agg(F.sum("value")).first()[0] == pytest.approx(x[10:21, :4].sum())
    assert got.where("t >= 23").count() == 0 and got.where("t < 0").count() == 0 and got.where("value > 1").count() == (x > 1).sum()
    with pytest.raises(Exception, match="outside the grid"):
        grids.write_zarr(frame, str(tmp_path / "small"), ["t", "c"], [22, 7], [10, 4])
    assert not (tmp_path / "small" / "zarr.json").exists()


def test_times(spark):
    at = lambda units, v: spark.range(1).select(F.date_format(grids.time_of(units, F.lit(v)), "yyyy-MM-dd HH:mm:ss")).first()[0]
    base = datetime.datetime(1800, 1, 1)
    assert at("hours since 1800-01-01 00:00:0.0", 1297320.0) == str(base + datetime.timedelta(hours=1297320))
    assert at("days since 1948-1-1", 59.5) == "1948-02-29 12:00:00" and at("seconds since 1970-01-01T00:01:30Z", 1.0) == "1970-01-01 00:01:31"
    with pytest.raises(ValueError):
        grids.time_of("fortnights since 1948-01-01", F.lit(1))


def test_query_returns_the_last_week(spark):
    from quillon.plans import catalogue, series

    sf = "/root/testdata/sf0.001"
    want = series.hourly(catalogue.Tables(spark, sf)).toPandas()
    want = want[want["t"] > want["t"].max() - 168]
    got = catalogue.queries()["src16_chunked_grid"](spark, sf).toPandas()
    key = lambda f: sorted(f[["t", "channel", "value"]].itertuples(index=False, name=None))
    assert len(got) == 168 * want["channel"].nunique() and key(got) == key(want)
