"""``python -m fieldshift --input FOLDER --output FOLDER``: analyse two dates and write the result tables."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.grid import CRS, covering_grid, project, project_box
from .operators import alignment, pixels
from .operators.quality import InputError, require_raster
from .plans.analysis import Analysis
from .sources import geotiff, layout, sinks

LOG = logging.getLogger("fieldshift")


def analyse(spark: SparkSession, folder: Path, out: Path) -> Analysis:
    inputs = layout.find_inputs(folder)
    polygons, crs = layout.read_boundary(inputs.boundary)
    polygons = [[list(zip(*(v.tolist() for v in project(*zip(*ring), crs, CRS)))) for ring in rings] for rings in polygons]
    xs, ys = zip(*[p for rings in polygons for ring in rings for p in ring])
    grid, edges = covering_grid(min(xs), min(ys), max(xs), max(ys)), alignment.rings_frame(spark, polygons)
    bands = {}
    for key, path in inputs.rasters.items():
        cells, (_, source, _) = geotiff.read(spark, str(path)), geotiff.describe(spark, str(path))[0]
        require_raster(cells, "value", source, project_box(grid.bounds, grid.crs, source.crs))
        bands[key] = alignment.clip(alignment.resample(cells, source, grid), edges, grid)
    first, second = layout.YEARS
    if inputs.kind == "bands":
        parts = {n: bands[f"{b}_{y}"] for n, b, y in (("red_base", "red", first), ("nir_base", "nir", first), ("red_target", "red", second), ("nir_target", "nir", second))}
    else:
        parts = {n: pixels.ready_index(bands[f"ndvi_{y}"]) for n, y in (("ndvi_base", first), ("ndvi_target", second))}
    joined = None
    for name, part in parts.items():
        part = part.select("row", "col", F.col("value").alias(name))
        joined = part if joined is None else joined.join(part, ["row", "col"])
    analysis = Analysis(pixels.index_from_bands(joined) if inputs.kind == "bands" else joined, grid)
    pixels.require_cells(analysis.pixels)
    out.mkdir(parents=True, exist_ok=True)
    tables, files = analysis.tables(), {}
    for name, table in tables.items():
        if name.startswith("ndvi_forecast"):
            table.write.mode("overwrite").parquet(str(out / name))
            geotiff.write(table, "forecast", str(out / f"{name}.tif"), grid)
            files[name] = out / f"{name}.tif"
        else:
            files[name] = out / f"{name}.csv"
            sinks.write_csv(table, files[name])
    small = {n: t for n, t in tables.items() if not n.startswith("ndvi_forecast")}
    summary = {"input": folder, "kind": inputs.kind, "grid": f"{grid.width} x {grid.height}", "crs": grid.crs}
    sinks.write_boxes(tables["largest_changes"], out / "change_regions.geojson")
    sinks.write_workbook(out / "report.xlsx", summary, small)
    sinks.write_report(out / "report.md", "Vegetation change", summary, small, files)
    return analysis


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fieldshift", description=__doc__)
    parser.add_argument("--input", type=Path, required=True)
    parser.add_argument("--output", type=Path, default=Path("output"))
    parser.add_argument("--log-level", default="INFO")
    options = parser.parse_args(arguments)
    logging.basicConfig(level=options.log_level.upper())
    spark = SparkSession.builder.appName("fieldshift").getOrCreate()
    try:
        checks = analyse(spark, options.input, options.output).checks.collect()
    except (InputError, ValueError, RuntimeError) as error:
        LOG.error("%s", error)
        return 1
    for check in checks:
        LOG.info("%s: %s", check.check, "PASS" if check.passed else "FAIL")
    return int(not all(c.passed for c in checks))


if __name__ == "__main__":
    sys.exit(main())
