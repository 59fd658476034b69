"""Message archives: framing, byte ranges and cells, by round trips."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.plans.archives import packed
from gridloom.sources import archives as A


def grid(seed, nj=5, ni=7, holes=0.0, top=1000):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, top, (nj, ni)).astype(float)
    g[rng.random((nj, ni)) < holes] = np.nan
    return g


@pytest.mark.parametrize("width", range(25))
def test_every_width_comes_back(width):
    g = grid(width, top=2**width)
    g[0, 0] = 2**width - 1
    g[1, 1] = 0
    lat, lon, value = A.cells(packed(g, 40.0, -3.5, 0.25, 0.5, ten=0, width=width))
    assert np.array_equal(value.reshape(g.shape), g)
    assert np.allclose(lat.reshape(g.shape)[:, 0], 40 - 0.5 * np.arange(5)) and np.allclose(lon.reshape(g.shape)[0], -3.5 + 0.25 * np.arange(7))


@pytest.mark.parametrize("scan, holes", list(itertools.product((a | b | c | d for a in (0, 0x80) for b in (0, 0x40) for c in (0, 0x20) for d in (0, 0x10)), (0.0, 0.4))))
def test_every_scan_order_comes_back(scan, holes):
    g = grid(scan, holes=holes) / 100 - 3
    lat, lon, value = A.cells(packed(g, 10.0, 100.0, scan=scan))
    assert np.allclose(value.reshape(g.shape), g, atol=0.006, equal_nan=True)
    assert np.allclose(lat.reshape(g.shape)[:, 0], 10 - np.arange(5)) and np.allclose(lon.reshape(g.shape)[0], 100 + np.arange(7))


def test_scaling_and_nothing_known():
    g = grid(1) * 64
    assert np.allclose(A.cells(packed(g, 0.0, 0.0, ten=0, two=6))[2].reshape(g.shape), g)
    assert np.isnan(A.cells(packed(np.full((2, 3), np.nan), 0.0, 0.0))[2]).all()
    with pytest.raises(A.BrokenMessage):
        A.cells(packed(g, 0.0, 0.0)[:40] + A.END)


def test_framing(spark):
    one, two = packed(grid(2), 1.0, 1.0), packed(grid(3), 1.0, 1.0)
    old = b"GRIB" + (20).to_bytes(3, "big") + b"\x01" + bytes(8) + b"7777"  # edition 1 states its length elsewhere
    rows = [("a", b"junk" + one + b"GR" + two), ("b", None), ("c", b""), ("d", old + one), ("e", b"no message")]
    found = A.split_messages(spark.createDataFrame([(*r, 1) for r in rows], "path string, content binary, k int")).collect()
    got = [(r.path, r.k, r.offset, bytes(r.message)) for r in sorted(found, key=lambda r: (r.path, r.k))]
    assert got == [("a", 0, 4, one), ("a", 1, 6 + len(one), two), ("d", 0, 0, old), ("d", 1, 20, one)]
    broken = spark.createDataFrame([("x", one + two[:-1]), ("y", b"GRIB\x00\x00\x00\x07" + bytes(20)), ("z", two), ("w", b"GRIB")], "path string, content binary")
    with pytest.raises(Exception, match="no whole message"):
        A.split_messages(broken).collect()
    assert [(r.path, r.k) for r in A.split_messages(broken, "skip").orderBy("path").collect()] == [("x", 0), ("z", 0)]


def archive(tmp_path):
    """Two files of five fields of one grid with their indexes, and a lot of bytes that nobody wants between two of the fields."""
    fields = [("TMP", "2 m above ground", "3 hour fcst"), ("APCP", "surface", "0-3 hour acc fcst"), ("APCP", "surface", "0-3 hour acc fcst"), ("OTHER", "surface", "3 hour fcst"), ("HGT", "surface", "3 hour fcst")]
    lines, grids = [], {}
    for f in ("one", "two"):
        path, blob = str(tmp_path / f), b""
        for k, (var, level, window) in enumerate(fields):
            g = grid(hash((f, k)) % 1000) / 10 + (270 if var == "TMP" else 0)
            lines.append((path, f"{k + 1}:{len(blob)}:d=2024010100:{var}:{level}:{window}:"))
            blob += packed(g, 30.0, 110.0) if var != "OTHER" else A.MAGIC + b"\x00\x00\x00\x02" + (3 << 20).to_bytes(8, "big") + bytes((3 << 20) - 20) + A.END
            grids.setdefault((f, var), g)
        with open(path, "wb") as out:
            out.write(blob)
    return lines, grids


def test_only_wanted_bytes_are_read(spark, tmp_path):
    lines, grids = archive(tmp_path)
    from gridloom.sources import reports

    index = reports.message_index(spark.createDataFrame(lines, "file string, line string")).where("var <> 'OTHER'").withColumnRenamed("file", "path")
    read = A.read_ranges(index.select("path", "seq", "offset", "length", "var")).collect()
    assert len(read) == 8 and all(r.message[:4] == A.MAGIC and r.message[-4:] == A.END and len(r.message) == (r.length or len(r.message)) for r in read)
    size = sum(os.path.getsize(tmp_path / f) for f in ("one", "two"))
    assert sum(r.fetched for r in read) == sum(len(r.message) for r in read) < size / 100
    assert sorted(r.fetched > 0 for r in read) == [False] * 4 + [True] * 4  # neighbours are fetched at once
    again = A.read_ranges(index.select("path", "seq", "offset", "length", "var"), gap=8 << 20).collect()
    assert sum(r.fetched for r in again) == size and sorted((r.path, r.seq, bytes(r.message)) for r in again) == sorted((r.path, r.seq, bytes(r.message)) for r in read)


def test_fields_of_archives(spark, tmp_path):
    lines, grids = archive(tmp_path)
    fields = {"t2m": ("TMP", "2 m above ground", "K"), "tp": ("APCP", "surface", "kg m-2"), "orog": ("HGT", "surface", "gpm")}
    first = [x for x in lines if x[0].endswith("one")]
    found = A.archived_fields(spark.createDataFrame(first, "file string, line string"), fields, ["APCP"], (27.0, 29.0, 111.0, 114.0)).collect()
    assert len(found) == 3 * 4
    for r in found:
        at = int(30 - r.lat), int(r.lon - 110)
        assert abs(r.t2m - (grids["one", "TMP"][at] - 273.15)) < 0.01 and abs(r.tp - grids["one", "APCP"][at]) < 0.01 and abs(r.orog - grids["one", "HGT"][at]) < 0.01 and r.step == 3


def test_cells_of_a_box_and_null_messages(spark):
    rows = [(1, "x", packed(grid(4, holes=0.3), 2.0, 178.0)), (2, None, None)]
    found = A.decode_cells(spark.createDataFrame(rows, "id int, name string, message binary"), ["id", "name"], (-1.0, 1.0, -180.0, -178.0))
    assert {(r.lat, r.lon) for r in found.collect()} == {(a, b) for a in (1.0, 0.0, -1.0) for b in (-180.0, -179.0, -178.0)}
    assert found.where(F.col("value").isNull()).count() == int(np.isnan(grid(4, holes=0.3)[1:4, 2:5]).sum())
