"""Archives of packed grid messages: framing, reading of byte ranges, and cells of a box.

Messages are of edition 2 of the public format for gridded binary data: numbered sections behind a head of 16 bytes.
Grids are regular in latitude and longitude, values simply packed, with or without a bitmap, in any scan order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: how a message begins, where each edition states its length, and how it ends.
MAGIC, END = b"GRIB", b"7777"
LENGTH_AT = {1: (4, 7), 2: (8, 16)}


class BrokenMessage(ValueError):
    """Bytes that begin as a message and are none."""


def framed(data: bytes | None, name: str = "") -> Iterator[tuple[int, int]]:
    """(offset, length) of each message of concatenated ones; other bytes between them are passed over."""
    data = data or b""
    begin = data.find(MAGIC)
    while begin >= 0:
        head = data[begin : begin + 16]
        place = LENGTH_AT.get(head[7] if len(head) > 7 else None)
        size = int.from_bytes(head[slice(*place)], "big") if place else 0
        if not 16 <= size <= len(data) - begin:
            raise BrokenMessage(f"{name} has no whole message of a known edition at {begin}")
        yield begin, size
        begin = data.find(MAGIC, begin + size)


FRAMES = pa.schema([("path", pa.string()), ("k", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("message", pa.binary())])


def split_messages(files: DataFrame, broken: str = "raise") -> DataFrame:
    """``files``: path, content. One row for each message: path, k, offset, length, message.

    Null and empty contents have none.  A broken file raises, or with ``broken='skip'`` costs what is behind its last whole
    message and nothing of other files.
    """

    def split(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows.extend((path, k, at, n, data[at : at + n]) for k, (at, n) in enumerate(framed(data, path)))
                except BrokenMessage:
                    if broken != "skip":
                        raise
            yield pa.RecordBatch.from_pylist([dict(zip(FRAMES.names, r)) for r in rows], schema=FRAMES)

    return files.select("path", "content").mapInArrow(split, "path string, k int, offset long, length long, message binary")


def read_ranges(wanted: DataFrame, gap: int = 64 << 10) -> DataFrame:
    """``wanted``: path, offset, length and other columns. The same rows with their bytes as ``message``, read from the files by range.

    Only the ranges are read, those less than ``gap`` bytes apart in one go; ``fetched`` is how many bytes a row's request
    had, 0 where an earlier row's request had brought it.  Rows without a length (an index's last message) are read to the
    file's end.  Paths are what Arrow's file systems open.  What is wanted of a file is read in one task; the index, where
    filters belong, is an ordinary table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = wanted.withColumn("message", F.lit(None).cast("binary")).withColumn("fetched", F.lit(0).cast("long")).schema
    schema = to_arrow_schema(out)

    def fetch(batches):
        from pyarrow import fs

        for b in batches:
            rows = sorted(b.to_pylist(), key=lambda r: (r["path"], r["offset"]))
            at = 0
            while at < len(rows):
                path, begin = rows[at]["path"], rows[at]["offset"]
                system, inside = fs.FileSystem.from_uri(path)
                with system.open_input_file(inside) as f:
                    size, to, stop = f.size(), at, begin
                    while to < len(rows) and rows[to]["path"] == path and rows[to]["offset"] <= stop + (gap if to > at else 0):
                        end = size if rows[to]["length"] is None else rows[to]["offset"] + rows[to]["length"]
                        stop, to = max(stop, min(end, size)), to + 1
                    data = f.read_at(stop - begin, begin)
                for k in range(at, to):
                    r = rows[k]
                    first = r["offset"] - begin
                    r["message"] = data[first : None if r["length"] is None else first + r["length"]]
                    r["fetched"] = len(data) if k == at else 0
                yield pa.RecordBatch.from_pylist(rows[at:to], schema=schema)
                at = to

    together = wanted.repartition("path").sortWithinPartitions("path", "offset")
    return together.mapInArrow(fetch, out)


# ---------------------------------------------------------------- cells


def _sections(message: bytes) -> dict[int, bytes]:
    """The sections of a message by number; a repeated one counts as its last."""
    found, at = {}, 16
    while message[at : at + 4] != END:
        size = int.from_bytes(message[at : at + 4], "big")
        if not 5 <= size <= len(message) - at:
            raise BrokenMessage(f"section of {size} bytes at {at}")
        found[message[at + 4]] = message[at : at + size]
        at += size
    return found


def _signed(raw: bytes) -> int:
    """Sign and magnitude, the highest bit being the sign."""
    n, top = int.from_bytes(raw, "big"), 1 << (8 * len(raw) - 1)
    return top - n if n >= top else n


def unpacked(raw: bytes, width: int, n: int) -> np.ndarray:
    """``n`` unsigned numbers of ``width`` bits each."""
    if not width:
        return np.zeros(n)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width)
    return bits @ (2.0 ** np.arange(width - 1, -1, -1))


def cells(message: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lat, lon, value) of all cells of a message's grid, northern rows first, west to east; missing values are NaN."""
    s = _sections(message)
    grid, pack, mask, raw = s[3], s[5], s[6], s[7][5:]
    if int.from_bytes(grid[12:14], "big") != 0 or int.from_bytes(pack[9:11], "big") != 0:
        raise BrokenMessage("neither a regular grid nor simple packing")
    ni, nj = (int.from_bytes(grid[a : a + 4], "big") for a in (30, 34))
    lat1, lon1, di, dj = _signed(grid[46:50]) / 1e6, _signed(grid[50:54]) / 1e6, int.from_bytes(grid[63:67], "big") / 1e6, int.from_bytes(grid[67:71], "big") / 1e6
    scan = grid[71]
    n, width = int.from_bytes(pack[5:9], "big"), pack[19]
    reference, two, ten = np.frombuffer(pack[11:15], ">f4")[0].astype(float), _signed(pack[15:17]), _signed(pack[17:19])
    values = (reference + unpacked(raw, width, n) * 2.0**two) / 10.0**ten
    if mask[5] == 0:
        there = np.unpackbits(np.frombuffer(mask[6:], np.uint8), count=ni * nj).astype(bool)
        whole = np.full(ni * nj, np.nan)
        whole[there] = values
        values = whole
    by_column, to_west, to_north, turning = bool(scan & 0x20), bool(scan & 0x80), bool(scan & 0x40), bool(scan & 0x10)
    table = values.reshape((ni, nj) if by_column else (nj, ni))
    if turning:
        table[1::2] = table[1::2, ::-1]
    table = table.T if by_column else table
    lat, lon = lat1 + np.arange(nj) * (dj if to_north else -dj), lon1 + np.arange(ni) * (-di if to_west else di)
    if to_north:
        table, lat = table[::-1], lat[::-1]
    if to_west:
        table, lon = table[:, ::-1], lon[::-1]
    return np.repeat(lat, ni), np.tile(lon, nj), table.reshape(-1)


CELL = [("cell", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64())]


def decode_cells(messages: DataFrame, keys: list[str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The cells of messages (keys, message) inside a box (lat_min, lat_max, lon_min, lon_max; longitudes from -180 to 180): keys, cell, lat, lon, value.

    ``cell`` counts the grid's cells from the north-west; missing values are null.  Rows with a null message give none.
    A task holds one message's grid at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = to_arrow_schema(messages.select(*keys).schema)
    schema = pa.schema([*kept, *CELL])

    def decode(batches):
        for b in batches:
            names = b.select(keys)
            for k, message in enumerate(b.column("message").to_pylist()):
                if message is None:
                    continue
                lat, lon, value = cells(message)
                lon = np.round((lon + 180) % 360 - 180, 6)
                inside = np.ones(len(lat), bool) if box is None else (lat >= box[0]) & (lat <= box[1]) & (lon >= box[2]) & (lon <= box[3])
                at = np.flatnonzero(inside)
                told = pa.Table.from_batches([names.slice(k, 1)]).take(pa.array(np.zeros(len(at), np.int64)))
                found = [pa.array(at.astype(np.int32)), pa.array(np.round(lat[at], 6)), pa.array(lon[at]), pa.array(value[at], from_pandas=True)]
                yield from pa.table([*[c.combine_chunks() for c in told.columns], *found], schema=schema).to_batches()

    ddl = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in messages.select(*keys).schema], "cell int, lat double, lon double, value double"])
    return messages.select(*keys, "message").mapInArrow(decode, ddl)


def archived_fields(index: DataFrame, fields: dict[str, tuple[str, str, str]], accumulated: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """Cells of the fields of archives: from the lines of their indexes (file, line) to canonical values, one row for each place and step.

    ``fields``: field -> (variable and level of the index, unit).  The wanted messages are chosen in the index, their bytes
    alone are read, and cells outside of the box are left out as soon as they are unpacked.
    """
    from gridloom.sources import messages, reports

    wanted = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("var"), F.lit(level).alias("level"), F.lit(unit).alias("unit")) for f, (v, level, unit) in fields.items()]))
    picked = reports.pick_messages(reports.message_index(index), accumulated)
    asked = index.sparkSession.range(1).select(wanted)
    chosen = picked.join(F.broadcast(asked), ["var", "level"])  # a row for each field
    step = F.regexp_extract("window", r"(\d+) hour", 1).cast("int")
    read = read_ranges(chosen.select(F.col("file").alias("path"), "offset", "length", "field", "unit", F.coalesce(step, F.lit(0)).alias("step")))
    return messages.normalised(decode_cells(read, ["field", "unit", "step"], box))
