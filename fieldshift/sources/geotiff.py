"""Single-band GeoTIFF files as pixel relations, and back.

Files are read by Spark as binary rows, so they may lie in any store it reads, and decoded where they land: many tiles
are many tasks. Uncompressed, deflate and LZW data in strips or tiles are understood.
"""

from __future__ import annotations

import logging
import math
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.grid import Grid

# TIFF and GeoTIFF tags, field types and the codes used here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 34735, 42112, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED, LINEAR_UNIT = 1024, 1025, 2048, 3072, 3076
# Metres in the linear units metre, foot and US survey foot.
UNITS = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937}
# The LZW codes that clear the table and end the data.
CLEAR, END = 256, 257

LOG = logging.getLogger(__name__)


class RasterError(ValueError):
    """The file is no raster that can be read here."""


@dataclass(frozen=True)
class Header:
    grid: Grid
    nodata: float | None
    scale: float = 1.0
    offset: float = 0.0


@dataclass(frozen=True)
class Raster(Header):
    values: np.ndarray | None = None


def _tags(data: bytes) -> tuple[str, dict]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise RasterError("no TIFF header")
    at = struct.unpack(order + "I", data[4:8])[0]
    found = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in TYPES:
            continue
        size = struct.calcsize(order + TYPES[kind]) * count
        raw = entry[8 : 8 + size] if size <= 4 else data[struct.unpack(order + "I", entry[8:])[0] :][:size]
        found[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else list(struct.unpack(f"{order}{count * len(TYPES[kind])}{TYPES[kind][0]}", raw))
    return order, found


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bits first, a code wider one entry before the table is full."""
    out, held, bits, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while True:
        while bits < width:
            if at == len(data):
                return bytes(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == END:
            return bytes(out)
        if code == CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise RasterError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))


def _block(raw: bytes, tags: dict, kind: np.dtype, width: int) -> np.ndarray:
    method = tags.get(COMPRESSION, [1])[0]
    if method in (8, 32946):
        raw = zlib.decompress(raw)
    elif method == 5:
        raw = unpack_lzw(raw)
    elif method != 1:
        raise RasterError(f"compression {method} is not read")
    predictor = tags.get(PREDICTOR, [1])[0]
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(-1, width * kind.itemsize), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(-1, kind.itemsize, width).swapaxes(1, 2)).view(kind.newbyteorder(">")).reshape(-1, width)
    out = np.frombuffer(raw[: len(raw) // (width * kind.itemsize) * width * kind.itemsize], kind).reshape(-1, width)
    return np.cumsum(out, axis=1, dtype=kind) if predictor == 2 else out


def header(data: bytes) -> Header:
    """What a file says of itself, without its values."""
    return _header(_tags(data)[1])


def _header(tags: dict) -> Header:
    if tags.get(SAMPLES, [1])[0] != 1:
        raise RasterError("one band is expected")
    if PIXEL_SCALE not in tags or TIE_POINT not in tags:
        raise RasterError("the raster has no place")
    keys = tags.get(GEO_KEYS, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    if not code:
        raise RasterError("the raster has no coordinate system")
    unit = codes.get(LINEAR_UNIT, 9001)
    if unit not in UNITS:
        raise RasterError(f"linear unit {unit} is not known")
    sx, sy = tags[PIXEL_SCALE][:2]
    i, j, _, x, y, _ = tags[TIE_POINT][:6]
    meta = {m[0].upper(): float(m[1]) for m in re.findall(r'name="(SCALE|OFFSET)"[^>]*>([^<]+)<', tags.get(GDAL_METADATA, ""), re.I)}
    scale, offset = meta.get("SCALE", 1.0), meta.get("OFFSET", 0.0)
    if scale == 0 or not math.isfinite(scale) or not math.isfinite(offset):
        raise RasterError(f"scale {scale} and offset {offset} give no values")
    nodata = tags.get(GDAL_NODATA)
    grid = Grid(x - i * sx, y + j * sy, sx, sy, tags[WIDTH][0], tags[HEIGHT][0], f"EPSG:{code}", UNITS[unit])
    return Header(grid, float(nodata) if nodata else None, scale, offset)


def decode(data: bytes) -> Raster:
    order, tags = _tags(data)
    known = _header(tags)
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    kind = np.dtype(f"{order}{KINDS[tags.get(SAMPLE_FORMAT, [1])[0]]}{tags[BITS][0] // 8}")
    values = np.empty((height, width), kind.newbyteorder("="))
    if TILE_OFFSETS in tags:
        tw, th = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        across = -(-width // tw)
        for i, (at, size) in enumerate(zip(tags[TILE_OFFSETS], tags[TILE_BYTES])):
            r, c = i // across * th, i % across * tw
            part = _block(data[at : at + size], tags, kind, tw)
            values[r : r + th, c : c + tw] = part[: height - r, : width - c]
    else:
        rows = min(height, tags.get(ROWS_PER_STRIP, [height])[0])
        for i, (at, size) in enumerate(zip(tags[STRIP_OFFSETS], tags[STRIP_BYTES])):
            part = _block(data[at : at + size], tags, kind, width)
            values[i * rows : i * rows + len(part)] = part[: height - i * rows]
    return Raster(known.grid, known.nodata, known.scale, known.offset, values)


def encode(values: np.ndarray, grid: Grid, nodata: float | None = raster.NODATA) -> bytes:
    """A deflate GeoTIFF in strips."""
    kind = values.dtype
    rows = max(1, (1 << 18) // max(1, values.shape[1] * kind.itemsize))
    strips = [zlib.compress(np.ascontiguousarray(values[r : r + rows], kind.newbyteorder("<")).tobytes()) for r in range(0, len(values), rows)]
    code = int(grid.crs.split(":")[1])
    geographic = code == 4326
    keys = [1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, code]
    entries = {
        WIDTH: (4, [values.shape[1]]), HEIGHT: (4, [values.shape[0]]), BITS: (3, [8 * kind.itemsize]), COMPRESSION: (3, [8]), PHOTOMETRIC: (3, [1]),
        STRIP_OFFSETS: (4, [0] * len(strips)), SAMPLES: (3, [1]), ROWS_PER_STRIP: (4, [rows]), STRIP_BYTES: (4, [len(s) for s in strips]),
        SAMPLE_FORMAT: (3, [{"u": 1, "i": 2, "f": 3}[kind.kind]]), PIXEL_SCALE: (12, [grid.cell_x, grid.cell_y, 0.0]),
        TIE_POINT: (12, [0.0, 0.0, 0.0, grid.left, grid.top, 0.0]), GEO_KEYS: (3, keys),
    }
    if nodata is not None:
        entries[GDAL_NODATA] = (2, f"{nodata:g}\0".encode())
    head = 8 + 2 + 12 * len(entries) + 4
    sized = {t: v if k == 2 else struct.pack(f"<{len(v)}{TYPES[k]}", *v) for t, (k, v) in entries.items()}
    at = head + sum(len(v) + len(v) % 2 for v in sized.values() if len(v) > 4)
    places = []
    for s in strips:
        places.append(at)
        at += len(s)
    sized[STRIP_OFFSETS] = struct.pack(f"<{len(places)}I", *places)
    table, extra, free = b"", b"", head
    for tag in sorted(entries):
        kind_code, value = entries[tag]
        raw = sized[tag]
        if len(raw) > 4:
            table += struct.pack("<HHII", tag, kind_code, len(value), free)
            extra += raw + b"\0" * (len(raw) % 2)
            free += len(raw) + len(raw) % 2
        else:
            table += struct.pack("<HHI", tag, kind_code, len(value)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + table + b"\0" * 4 + extra + b"".join(strips)


def read(spark: SparkSession, path: str, scaled: bool = True) -> DataFrame:
    """(path, row, col, value FLOAT) of the valid cells of all files at ``path``.

    Cells that are not finite or close to nodata are absent; scale and offset are applied after that test.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unfold(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                image = decode(bytes(content))
                values = image.values.astype(np.float32)
                valid = np.isfinite(values)
                if image.nodata is not None:
                    valid &= ~np.isclose(values, image.nodata)
                if scaled and (image.scale, image.offset) != (1.0, 0.0):
                    values = values * np.float32(image.scale) + np.float32(image.offset)
                for top in range(0, len(values), 512):
                    row, col = np.nonzero(valid[top : top + 512])
                    yield pd.DataFrame({"path": name, "row": (row + top).astype(np.int32), "col": col.astype(np.int32), "value": values[row + top, col]})

    return files.mapInPandas(unfold, "path string, row int, col int, value float")


def describe(spark: SparkSession, path: str) -> list[tuple[str, Grid, float | None]]:
    """(path, grid, nodata) of each file, from its header: a row per raster. A file without nodata is logged."""

    def look(frames):
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                image = header(bytes(content))
                g = image.grid
                rows.append((name, g.left, g.top, g.cell_x, g.cell_y, g.width, g.height, g.crs, g.metres, image.nodata))
            yield pd.DataFrame(rows, columns=["path", "left", "top", "cell_x", "cell_y", "width", "height", "crs", "metres", "nodata"])

    schema = "path string, left double, top double, cell_x double, cell_y double, width int, height int, crs string, metres double, nodata double"
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(look, schema).collect()
    for r in rows:
        if r.nodata is None:
            LOG.warning("%s sets no nodata value", r.path)
    return [(r.path, Grid(r["left"], r.top, r.cell_x, r.cell_y, r.width, r.height, r.crs, r.metres), r.nodata) for r in rows]


def write(cells: DataFrame, value: str, path: str, grid: Grid, nodata: float = raster.NODATA, kind: str = "float32", most: int = 200_000_000) -> None:
    """One file with the cells' values, rows coming to the driver in order; larger grids go out as Parquet tables."""
    if grid.width * grid.height > most:
        raise RasterError("the grid is too large for one file")
    values = np.full((grid.height, grid.width), nodata, kind)
    rows = cells.where(F.col(value).isNotNull()).groupBy("row").agg(F.collect_list(F.struct("col", F.col(value).alias("v"))).alias("line"))
    for r in rows.toLocalIterator():
        for c, v in r.line:
            values[r.row, c] = v
    with open(path, "wb") as file:
        file.write(encode(values, grid, nodata))
