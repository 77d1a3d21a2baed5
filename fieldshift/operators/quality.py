"""Checks of inputs and results, as one table of named outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.grid import Grid


class InputError(ValueError):
    """The given data can't be analysed."""


def band_metadata(cells: DataFrame, value: str, grid: Grid, nodata: float | None = raster.NODATA) -> DataFrame:
    """One row per raster: extent, cell size, valid cells and the extremes of unscaled values."""
    x = raster.unmasked(F.col(value), nodata).cast("double")
    return cells.agg(F.count(x).alias("valid_count"), F.min(x).alias("valid_min"), F.max(x).alias("valid_max")).select(
        F.lit(grid.crs).alias("crs"), F.lit(grid.width).alias("width"), F.lit(grid.height).alias("height"), F.lit(grid.cell_x).alias("pixel_size_x"),
        F.lit(grid.cell_y).alias("pixel_size_y"), F.lit(nodata).cast("double").alias("nodata"), "valid_count", "valid_min", "valid_max",
    )


def require_raster(cells: DataFrame, value: str, grid: Grid, boundary: tuple[float, float, float, float] | None = None) -> None:
    """Raise unless there is a valid cell and the grid meets the boundary's box."""
    if cells.where(raster.finite(F.col(value).cast("double"))).isEmpty():
        raise InputError("the raster has no valid cell")
    if boundary is not None:
        left, bottom, right, top = grid.bounds
        if boundary[0] >= right or boundary[2] <= left or boundary[1] >= top or boundary[3] <= bottom:
            raise InputError("the raster lies outside the boundary")


def _check(name: str, table: DataFrame, passed: Column) -> DataFrame:
    return table.agg(F.coalesce(passed, F.lit(False)).alias("passed")).select(F.lit(name).alias("check"), "passed")


def _within(name: str, cells: DataFrame, value: str, low: float, high: float) -> DataFrame:
    x = F.col(value).cast("double")
    return _check(name, cells, (F.min(x) >= low - 1e-6) & (F.max(x) <= high + 1e-6))


def _columns(name: str, table: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return table.sparkSession.createDataFrame([(name, set(wanted) <= set(table.columns))], "check string, passed boolean")


def report(pixels: DataFrame, statistics: DataFrame, matrix: DataFrame, regions: DataFrame, forecast: DataFrame) -> DataFrame:
    """(check, passed): ranges, equal grids, no nodata left, complete tables, and sums that agree."""
    keys = ["row", "col"]
    pairs = pixels.where("class_base <> 0 and class_target <> 0").agg(F.count("*").alias("n"))
    sums = matrix.agg(F.sum("pixel_count").alias("cells"), F.sum("percent").alias("whole")).crossJoin(pairs)
    apart = pixels.join(forecast, keys, "left_anti").select("row").unionAll(forecast.join(pixels, keys, "left_anti").select("row"))
    left = F.count(F.when(F.abs(F.col("ndvi_base") - F.lit(raster.NODATA)) < 1, 1)) == 0
    checks = [
        _within("ndvi_range", pixels, "ndvi_base", -1, 1),
        _within("target_ndvi_range", pixels, "ndvi_target", -1, 1),
        _within("delta_range", pixels, "delta", -2, 2),
        _within("forecast_range", forecast, "forecast", -1, 1),
        _check("spatial_grid", apart, F.count("*") == 0),
        _check("nodata_masks", pixels, left),
        _columns("statistics", statistics, ("metric", "pixel_count", "mean", "minimum", "maximum", "median", "std")),
        _check("transition_matrix", sums, F.max((F.col("cells") == F.col("n")) & (F.abs(F.col("whole") - 100) <= 0.01))),
        _columns("change_polygons", regions, ("change_type", "delta_class", "area_m2", "area_ha", "bbox_min_x", "bbox_min_y", "bbox_max_x", "bbox_max_y", "rank")),
    ]
    return reduce(DataFrame.unionAll, checks)
