"""Input folders: which rasters and which boundary they hold, by file name; and boundary files."""

from __future__ import annotations

import json
import math
import re
import sqlite3
import struct
from dataclasses import dataclass
from pathlib import Path

from ..operators.quality import InputError

# File names and kinds.
YEARS = (2015, 2025)
BAND_FILES = {"red_2015": "B04_2015.tif", "nir_2015": "B08_2015.tif", "red_2025": "B04_2025.tif", "nir_2025": "B08_2025.tif"}
INDEX_FILES = {"ndvi_2015": "ndvi2015.tif", "ndvi_2025": "ndvi2025.tif"}
BOUNDARY_KINDS = (".gpkg", ".shp", ".geojson")
SHAPE_PARTS = (".shx", ".dbf", ".prj")


@dataclass(frozen=True)
class Inputs:
    kind: str  # "bands" or "index"
    rasters: dict[str, Path]
    boundary: Path


def find_rasters(folder: Path) -> tuple[str, dict[str, Path]]:
    """All four bands, else both ready indexes, else any two ``ndvi*.tif``; an error names what is missing."""
    for kind, names in (("bands", BAND_FILES), ("index", INDEX_FILES)):
        found = {key: folder / name for key, name in names.items() if (folder / name).is_file()}
        if len(found) == len(names):
            return kind, found
    loose = sorted((p for p in folder.glob("*") if re.fullmatch(r"ndvi.*\.tif", p.name, re.I)), key=lambda p: p.name.lower())
    if loose:
        if len(loose) != 2:
            raise InputError(f"two index files are expected, found {[p.name for p in loose]}")
        return "index", _by_year(loose)
    lacking = [n for n in (*BAND_FILES.values(), *INDEX_FILES.values()) if not (folder / n).is_file()]
    raise InputError(f"no complete set of rasters in {folder}; missing {', '.join(lacking)}")


def _by_year(pair: list[Path]) -> dict[str, Path]:
    """By the year in each name if both years are there, else in name order."""
    years = {int(m[0]): p for p in pair if (m := re.search(r"20\d{2}|19\d{2}", p.stem))}
    ordered = [years[y] for y in YEARS] if set(YEARS) <= set(years) else pair
    return {f"ndvi_{y}": p for y, p in zip(YEARS, ordered)}


def find_boundary(folder: Path) -> Path:
    found = sorted(p for p in folder.glob("*") if p.suffix.lower() in BOUNDARY_KINDS)
    if len(found) != 1:
        raise InputError(f"one boundary file is expected in {folder}, found {[p.name for p in found]}")
    return found[0]


def find_inputs(folder: str | Path) -> Inputs:
    folder = Path(folder)
    kind, rasters = find_rasters(folder)
    return Inputs(kind, rasters, find_boundary(folder))


Polygon = list[list[tuple[float, float]]]


def read_boundary(path: Path) -> tuple[list[Polygon], str]:
    """Polygons (outer ring first) and the coordinate system of a boundary file."""
    readers = {".geojson": _geojson, ".gpkg": _geopackage, ".shp": _shapefile}
    polygons, crs = readers[path.suffix.lower()](path)
    if not polygons or any(len(ring) < 4 for rings in polygons for ring in rings):
        raise InputError(f"{path.name} holds no valid polygon")
    if any(not all(math.isfinite(v) for p in ring for v in p) for rings in polygons for ring in rings):
        raise InputError(f"{path.name} has coordinates that are not finite")
    if not any(_twice_area(rings[0]) for rings in polygons):
        raise InputError(f"{path.name} covers no area")
    return polygons, crs


def _twice_area(ring: list[tuple[float, float]]) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:]))


def _geojson(path: Path) -> tuple[list[Polygon], str]:
    data = json.loads(path.read_text(encoding="utf-8"))
    shapes = [f["geometry"] for f in data.get("features", [])] or [data.get("geometry", data)]
    code = re.search(r"EPSG:{1,2}(\d+)", json.dumps(data.get("crs", "")))
    polygons = []
    for shape in filter(None, shapes):
        if shape["type"] not in ("Polygon", "MultiPolygon"):
            raise InputError(f"{shape['type']} is no area")
        parts = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
        polygons += [[[(x, y) for x, y, *_ in ring] for ring in part] for part in parts]
    return polygons, f"EPSG:{code[1]}" if code else "EPSG:4326"


def _well_known(data: bytes, at: int = 0) -> tuple[list[Polygon], int]:
    order = "<" if data[at] else ">"
    kind, count = struct.unpack_from(order + "II", data, at + 1)
    dims = 2 + (kind // 1000 in (1, 2, 3)) + (kind // 1000 == 3)
    at += 9
    polygons = []
    if kind % 1000 == 3:
        rings = []
        for _ in range(count):
            n = struct.unpack_from(order + "I", data, at)[0]
            flat = struct.unpack_from(f"{order}{n * dims}d", data, at + 4)
            rings.append(list(zip(flat[::dims], flat[1::dims])))
            at += 4 + 8 * n * dims
        polygons.append(rings)
    elif kind % 1000 == 6:
        for _ in range(count):
            part, at = _well_known(data, at)
            polygons += part
    else:
        raise InputError("a boundary holds polygons only")
    return polygons, at


def _geopackage(path: Path) -> tuple[list[Polygon], str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        table, column, system = con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchone()
        blobs = [b for (b,) in con.execute(f'SELECT "{column}" FROM "{table}"') if b]
    polygons = []
    for blob in blobs:
        envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
        polygons += _well_known(blob, 8 + envelope)[0]
    return polygons, f"EPSG:{system}"


def _shapefile(path: Path) -> tuple[list[Polygon], str]:
    lacking = [s for s in SHAPE_PARTS if not path.with_suffix(s).is_file()]
    if lacking:
        raise InputError(f"{path.name} lacks its parts {lacking}")
    data, at, polygons = path.read_bytes(), 100, []
    while at < len(data):
        size = struct.unpack_from(">I", data, at + 4)[0] * 2
        kind = struct.unpack_from("<I", data, at + 8)[0]
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<II", data, at + 44)
            first = [*struct.unpack_from(f"<{parts}I", data, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            rings = [list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2])) for a, b in zip(first, first[1:])]
            for ring in rings:
                if _twice_area(ring) < 0 or not polygons:
                    polygons.append([ring])  # outer rings run clockwise
                else:
                    polygons[-1].append(ring)
        at += 8 + size
    text = path.with_suffix(".prj").read_text(encoding="latin-1")
    code = re.search(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]\]$', text.strip())
    zone = re.search(r"UTM_zone_(\d+)([NS])", text, re.I)
    if code:
        return polygons, f"EPSG:{code[1]}"
    if zone and re.search(r"WGS_?\s?(19)?84", text, re.I):
        return polygons, f"EPSG:{(32600 if zone[2].upper() == 'N' else 32700) + int(zone[1])}"
    if "PROJCS" not in text.upper() and re.search(r"WGS_?\s?(19)?84", text, re.I):
        return polygons, "EPSG:4326"
    raise InputError(f"{path.name} has a coordinate system that is not known here")
