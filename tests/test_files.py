"""Files in and out, and the whole analysis from a folder."""

import json
import sqlite3
import struct
import zipfile

import numpy as np
import pytest

from fieldshift import __main__ as cli
from fieldshift.functions.grid import Grid, project, project_box
from fieldshift.operators import alignment
from fieldshift.operators.quality import InputError
from fieldshift.sources import geotiff, layout, sinks
from fieldshift.streaming import tiles

GRID = Grid(500000.0, 6650000.0, 10.0, 10.0, 40, 30)


def field(seed, level):
    rng = np.random.default_rng(seed)
    coarse = rng.random((6, 8)) * 0.9 + level
    return np.kron(coarse, np.ones((5, 5))).astype(np.float32)


@pytest.mark.parametrize("kind", ["float32", "int16", "uint8", "float64"])
def test_geotiff_round_trip(spark, tmp_path, kind):
    values = (np.arange(1200).reshape(30, 40) % 120).astype(kind)
    values[3, 4] = 119
    path = tmp_path / "a.tif"
    path.write_bytes(geotiff.encode(values, GRID, 119))
    image = geotiff.decode(path.read_bytes())
    assert np.array_equal(image.values, values) and image.grid == GRID and image.nodata == 119
    cells = geotiff.read(spark, str(path))
    assert cells.count() == int((values != 119).sum())
    assert geotiff.describe(spark, str(path))[0][1:] == (GRID, 119.0)
    geotiff.write(cells, "value", str(tmp_path / "b.tif"), GRID, 119, kind)
    assert np.array_equal(geotiff.decode((tmp_path / "b.tif").read_bytes()).values, values)


def test_not_a_raster():
    with pytest.raises(geotiff.RasterError):
        geotiff.decode(b"nothing like a raster")


RING = [(500000.0, 6649700.0), (500400.0, 6649700.0), (500400.0, 6650000.0), (500000.0, 6650000.0), (500000.0, 6649700.0)]


def boundary(folder):
    shape = {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [RING]}}
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32636"}}
    (folder / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": crs, "features": [shape]}))


def test_discovery(tmp_path):
    with pytest.raises(InputError, match="B04_2015"):
        layout.find_rasters(tmp_path)
    for name in ("ndvi_b.tif", "NDVI_a.tif"):
        (tmp_path / name).touch()
    kind, found = layout.find_rasters(tmp_path)
    assert kind == "index" and found["ndvi_2015"].name == "NDVI_a.tif"
    (tmp_path / "ndvi_c.tif").touch()
    with pytest.raises(InputError):
        layout.find_rasters(tmp_path)
    for name in layout.INDEX_FILES.values():
        (tmp_path / name).touch()
    assert layout.find_rasters(tmp_path)[0] == "index"
    for name in layout.BAND_FILES.values():
        (tmp_path / name).touch()
    assert layout.find_rasters(tmp_path)[0] == "bands"
    with pytest.raises(InputError):
        layout.find_boundary(tmp_path)
    boundary(tmp_path)
    assert layout.find_boundary(tmp_path).name == "b.geojson"
    assert layout._by_year([tmp_path / "ndvi_2025x.tif", tmp_path / "ndvi_2015y.tif"])["ndvi_2015"].name == "ndvi_2015y.tif"


def test_boundaries(tmp_path):
    boundary(tmp_path)
    assert layout.read_boundary(tmp_path / "b.geojson") == ([[RING]], "EPSG:32636")
    flat = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [2, 0], [0, 0]]]}
    (tmp_path / "flat.geojson").write_text(json.dumps(flat))
    with pytest.raises(InputError, match="no area"):
        layout.read_boundary(tmp_path / "flat.geojson")
    shape = struct.pack("<BIII", 1, 3, 1, len(RING)) + b"".join(struct.pack("<dd", *p) for p in RING)
    with sqlite3.connect(tmp_path / "b.gpkg") as con:
        con.execute("create table gpkg_geometry_columns (table_name, column_name, srs_id)")
        con.execute("insert into gpkg_geometry_columns values ('area', 'geom', 32636)")
        con.execute("create table area (geom blob)")
        con.execute("insert into area values (?)", (b"GP\0\1" + struct.pack("<i", 32636) + shape,))
    assert layout.read_boundary(tmp_path / "b.gpkg") == ([[RING]], "EPSG:32636")
    clockwise = RING[::-1]
    record = struct.pack("<I4dII", 5, 0, 0, 0, 0, 1, len(RING)) + struct.pack("<I", 0) + b"".join(struct.pack("<dd", *p) for p in clockwise)
    (tmp_path / "b.shp").write_bytes(b"\0" * 100 + struct.pack(">II", 1, len(record) // 2) + record)
    with pytest.raises(InputError):
        layout.read_boundary(tmp_path / "b.shp")
    for part in (".shx", ".dbf"):
        (tmp_path / f"b{part}").touch()
    (tmp_path / "b.prj").write_text('PROJCS["WGS_1984_UTM_Zone_36N"]')
    assert layout.read_boundary(tmp_path / "b.shp") == ([[clockwise]], "EPSG:32636")


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, "a&b", 0.123456789), (2, None, 2.0)], "id int, name string, x double")
    sinks.write_csv(table, tmp_path / "t.csv")
    assert (tmp_path / "t.csv").read_text().splitlines()[1] == "1,a&b,0.123456789"
    sinks.write_workbook(tmp_path / "t.xlsx", {"k": 1.5}, {"a/b": table})
    with zipfile.ZipFile(tmp_path / "t.xlsx") as book:
        assert "a_b" in book.read("xl/workbook.xml").decode() and "a&amp;b" in book.read("xl/worksheets/s1.xml").decode()
    sinks.write_report(tmp_path / "t.md", "T", {"k": 1}, {"t": table}, {})
    assert "| 1 | a&b | 0.123457 |" in (tmp_path / "t.md").read_text()
    assert len(sinks.sheet_name("x" * 50)) == 31


def test_folder_to_tables(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    boundary(folder)
    for name, values in (("ndvi2015.tif", field(1, 0.0)), ("ndvi2025.tif", field(2, -0.1))):
        (folder / name).write_bytes(geotiff.encode(values, GRID, -9999))
    assert cli.main(["--input", str(folder), "--output", str(out), "--log-level", "ERROR"]) == 0
    forecast = geotiff.decode((out / "ndvi_forecast_2035.tif").read_bytes()).values
    assert forecast.shape == (30, 40) and forecast.min() >= -1 and forecast.max() <= 1
    assert {"transition_matrix.csv", "largest_changes.csv", "report.md", "report.xlsx", "change_regions.geojson"} <= {p.name for p in out.iterdir()}
    (folder / "ndvi2025.tif").unlink()
    assert cli.main(["--input", str(folder), "--output", str(out), "--log-level", "CRITICAL"]) == 1


def test_arriving_tiles(spark, tmp_path):
    rows = [(r, c, 0.1, 0.3, 0.2, 0.3) for r in range(4) for c in range(5)]
    tile = spark.createDataFrame(rows, tiles.BANDS)
    for _ in range(2):
        tile.write.mode("append").parquet(str(tmp_path / "tiles"))
        tiles.start(spark, str(tmp_path / "tiles"), "arrived", str(tmp_path / "state")).awaitTermination()
        if _ == 0:
            spark.catalog.dropTempView("arrived")
    got = {(r.class_base, r.class_target): r.pixel_count for r in spark.table("arrived").collect()}
    assert got == {(4, 2): 40}


def lzw(data: bytes) -> bytes:
    """TIFF's LZW, for reading tests."""
    bits = ""
    table: dict[bytes, int] = {}

    def clear():
        table.clear()
        table.update({bytes([i]): i for i in range(256)})

    clear()
    size, width, word = 258, 9, b""
    bits += f"{256:09b}"
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        bits += f"{table[word]:0{width}b}"
        table[longer], size = size, size + 1
        width = size.bit_length()
        if size == 4095:
            bits += f"{256:0{min(width, 12)}b}"
            clear()
            size, width = 258, 9
        word = bytes([b])
    if word:
        bits += f"{table[word]:0{width}b}"
        size += 1
    bits += f"{257:0{size.bit_length()}b}"
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("size", [0, 1, 300, 5000, 60000])
def test_lzw(size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size, dtype=np.uint8).tobytes(), rng.integers(0, 3, size, dtype=np.uint8).tobytes(), b"a" * size):
        assert geotiff.unpack_lzw(lzw(data)) == data
    with pytest.raises(geotiff.RasterError):
        geotiff.unpack_lzw(b"\x80\x7f\xff\xff")


def test_header_without_values(tmp_path, spark):
    data = geotiff.encode(np.ones((30, 40), np.float32), GRID, None)
    assert geotiff.header(data[:2000]).grid == GRID  # values may be missing
    (tmp_path / "plain.tif").write_bytes(data)
    assert geotiff.describe(spark, str(tmp_path / "plain.tif"))[0][1:] == (GRID, None)
    order, tags = geotiff._tags(data)
    keys = tags[geotiff.GEO_KEYS]
    feet = {**tags, geotiff.GEO_KEYS: [*keys[:3], keys[3] + 1, *keys[4:], geotiff.LINEAR_UNIT, 0, 1, 9002]}
    assert geotiff._header(feet).grid.cell_area == pytest.approx(100 * 0.3048**2)
    for scale in ("0", "nan", "inf"):
        with pytest.raises(geotiff.RasterError):
            geotiff._header({**tags, geotiff.GDAL_METADATA: f'<Item name="SCALE" sample="0">{scale}</Item>'})


def test_boundaries_and_rasters_in_other_systems(spark, tmp_path):
    x, y = np.array([500100.0, 503000.0]), np.array([6649000.0, 6650000.0])
    for crs in ("EPSG:4326", "EPSG:3857", "EPSG:32635", "EPSG:32637", "EPSG:32736"):
        there = project(x, y, "EPSG:32636", crs)
        assert np.allclose(project(*there, crs, "EPSG:32636"), [x, y], atol=1e-4)
    lon, lat = project(np.array([0.0, 20037508.342789]), np.array([0.0, 20037508.342789]), "EPSG:3857", "EPSG:4326")
    assert np.allclose(lon, [0, 180]) and np.allclose(lat, [0, 85.0511287798])
    box = project_box(GRID.bounds, "EPSG:32636", "EPSG:32637")
    back = project_box(box, "EPSG:32637", "EPSG:32636")
    assert back[0] <= GRID.bounds[0] and back[3] >= GRID.bounds[3]
    with pytest.raises(ValueError):
        project(x, y, "EPSG:2154", "EPSG:32636")
    # a raster in the next zone: a plane in its own coordinates keeps its values at the same places
    bx = project_box((500000.0, 6649800.0, 500200.0, 6650000.0), "EPSG:32636", "EPSG:32637")
    source = Grid(bx[0] - 40, bx[3] + 40, 10.0, 10.0, int((bx[2] - bx[0]) / 10) + 10, int((bx[3] - bx[1]) / 10) + 10, "EPSG:32637")
    cells = spark.range(source.height).selectExpr("cast(id as int) row", f"explode(sequence(0, {source.width - 1})) col").selectExpr("row", "col", "cast(row * 2 + col as float) value")
    target = Grid(500000.0, 6650000.0, 10.0, 10.0, 20, 20)
    got = {(r.row, r.col): r.value for r in alignment.resample(cells, source, target).collect()}
    assert len(got) == 400
    for (r, c), v in got.items():
        sx, sy = project([500005.0 + 10 * c], [6649995.0 - 10 * r], "EPSG:32636", "EPSG:32637")
        assert v == pytest.approx((source.top - sy[0]) / 10 * 2 - 1 + (sx[0] - source.left) / 10 - 0.5, abs=1e-2)
    with pytest.raises(ValueError):
        alignment.resample(cells, Grid(0.0, 0.0, 1.0, 1.0, 2, 2, "EPSG:2154"), target)


def test_unknown_systems_are_refused(tmp_path):
    raw = struct.pack("<i", 5) + struct.pack("<4d", 0, 0, 1, 1) + struct.pack("<2i", 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)])
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + 8 + len(raw)) // 2).ljust(100, b"\0")
    (tmp_path / "b.shp").write_bytes(head + struct.pack(">2i", 1, len(raw) // 2) + raw)
    for part in layout.SHAPE_PARTS:
        (tmp_path / "b").with_suffix(part).touch()
    (tmp_path / "b.shp").write_bytes(head + struct.pack(">2i", 1, len(raw) // 2) + raw)
    for text, crs in [
        ('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]', "EPSG:4326"), ('PROJCS["WGS_1984_UTM_Zone_35N",GEOGCS["GCS_WGS_1984"]]', "EPSG:32635"),
        ('PROJCS["RGF93_Lambert_93",GEOGCS["GCS_RGF_1993"]]', None), ('GEOGCS["GCS_NAD27"]', None),
    ]:
        (tmp_path / "b.prj").write_text(text)
        if crs:
            assert layout.read_boundary(tmp_path / "b.shp")[1] == crs
        else:
            with pytest.raises(InputError):
                layout.read_boundary(tmp_path / "b.shp")
