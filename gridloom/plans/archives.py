"""Queries of message archives: the events as grids, packed, framed, and unpacked again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.plans.catalog import query, table
from gridloom.sources import archives


def packed(values: np.ndarray, lat: float, lon: float, di: float = 1.0, dj: float = 1.0, scan: int = 0, ten: int = 2, two: int = 0, width: int | None = None) -> bytes:
    """A grid (rows from the north, cells from the west, NaN missing) as a message: its north-west corner, steps, scan order and packing."""
    nj, ni = values.shape
    to_west, to_north, by_column, turning = (bool(scan & bit) for bit in (0x80, 0x40, 0x20, 0x10))
    v = values[::-1] if to_north else values
    v = v[:, ::-1] if to_west else v
    v = (v.T if by_column else v).copy()
    if turning:
        v[1::2] = v[1::2, ::-1]
    flat = v.reshape(-1)
    there = ~np.isnan(flat)
    known = flat[there]
    base = np.float32(known.min() * 10.0**ten) if len(known) else np.float32(0)
    whole = np.rint((known * 10.0**ten - float(base)) / 2.0**two).astype(np.int64)
    width = int(whole.max()).bit_length() if width is None and len(whole) else width or 0
    bits = (whole[:, None] >> np.arange(width - 1, -1, -1)) & 1
    n32 = lambda x: int(x).to_bytes(4, "big")
    sign = lambda x, size: (abs(int(x)) | ((1 << (8 * size - 1)) if x < 0 else 0)).to_bytes(size, "big")
    micro = lambda x: sign(round(x * 1e6), 4)
    first = lat - (nj - 1) * dj if to_north else lat, lon + (ni - 1) * di if to_west else lon
    grid = b"\x00" + n32(ni * nj) + b"\x00\x00" + b"\x00\x00" + b"\x06" + bytes(15) + n32(ni) + n32(nj) + bytes(8) + micro(first[0]) + micro(first[1]) + b"\x30" + bytes(8) + n32(round(di * 1e6)) + n32(round(dj * 1e6)) + bytes([scan])
    parts = {
        1: bytes(16), 3: grid, 4: bytes(4), 5: n32(len(known)) + b"\x00\x00" + np.array([base], ">f4").tobytes() + sign(two, 2) + sign(ten, 2) + bytes([width, 0]),
        6: b"\xff" if there.all() else b"\x00" + np.packbits(there).tobytes(), 7: np.packbits(bits.astype(np.uint8).reshape(-1)).tobytes(),
    }
    body = b"".join(n32(len(p) + 5) + bytes([k]) + p for k, p in parts.items()) + archives.END
    return archives.MAGIC + b"\x00\x00\x00\x02" + (len(body) + 16).to_bytes(8, "big") + body


def station_files(spark, sf_dir):
    """A file for each region, a message for each event type: the largest value of each day (from north to south) and hour (from west to east)."""
    import pandas as pd

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("string").alias("path"), "event_type", F.date_diff(F.to_date("ts"), F.lit("2024-01-01")).alias("day"), F.hour("ts").alias("hour"), "value")
    e = e.where("day BETWEEN 0 AND 29").groupBy("path", "event_type", "day", "hour").agg(F.max("value").alias("value"))

    def pack(key, pdf):
        messages = []
        for _, g in sorted(pdf.groupby("event_type")):
            grid = np.full((30, 24), np.nan)
            grid[g["day"], g["hour"]] = g["value"]
            messages.append(packed(grid, 30.0, 0.0, scan=(0x00, 0x40, 0x80, 0x20, 0x70)[len(messages) % 5]))
        return pd.DataFrame({"path": [key[0]], "content": [b"head".join(messages)]})

    return e.groupBy("path").applyInPandas(pack, "path string, content binary")  # at most 3,600 cells for each file


@query("""WITH e AS (SELECT CAST(user_id % 10 AS VARCHAR) AS path, event_type, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day, hour(ts) AS hour, max(value) AS value FROM events GROUP BY ALL), k AS (SELECT path, event_type, row_number() OVER (PARTITION BY path ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT path, event_type FROM e WHERE day BETWEEN 0 AND 29)),
 g AS (SELECT path, k, event_type, d AS day, h AS hour FROM k, range(30) a(d), range(24) b(h) WHERE 30 - d BETWEEN 5 AND 25 AND h BETWEEN 3 AND 20)
SELECT path, CAST(k AS INT) AS k, CAST(day * 24 + hour AS INT) AS cell, CAST(30 - day AS DOUBLE) AS lat, CAST(hour AS DOUBLE) AS lon, round(value, 2) AS value FROM g LEFT JOIN e USING (path, event_type, day, hour)""")
def grid_messages(spark, sf_dir):
    """Framing and cells of a box: what was packed comes back."""
    cells = archives.decode_cells(archives.split_messages(station_files(spark, sf_dir)), ["path", "k"], (5.0, 25.0, 3.0, 20.0))
    return cells.withColumn("value", F.round("value", 2))
