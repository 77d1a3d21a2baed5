"""Cell-wise operators: index, common mask, change, classes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.rules import CHANGE_RULES, INDEX_RULES, classify

KEYS = ["row", "col"]


def index_from_bands(bands: DataFrame) -> DataFrame:
    """(row, col, ndvi_base, ndvi_target) from four bands; a null index is kept as null."""
    return bands.select(
        *KEYS,
        raster.vegetation_index(F.col("red_base"), F.col("nir_base")).alias("ndvi_base"),
        raster.vegetation_index(F.col("red_target"), F.col("nir_target")).alias("ndvi_target"),
    )


def ready_index(stored: DataFrame, value: str = "value") -> DataFrame:
    """A stored index as FLOAT, its form told by the extremes over all cells; unknown forms raise.

    The extremes are one row, joined back by broadcast.
    """
    known = stored.where(raster.finite(F.col(value)))
    low, high = known.agg(F.min(value), F.max(value)).first()
    if low is None:
        raise ValueError("no valid cell")
    edge = raster.INDEX_MAX + raster.FORMAT_TOLERANCE
    if -edge <= low and high <= edge:
        factor = None
    elif max(abs(low), abs(high)) <= raster.STORED_LIMIT:
        factor = raster.STORED_SCALE
    else:
        raise ValueError(f"values from {low} to {high} are no stored index")
    x = F.col(value).cast("float")
    return known.withColumn(value, x if factor is None else (x / F.lit(factor)).cast("float"))


def common_mask(dates: Sequence[DataFrame], value: str = "ndvi") -> DataFrame:
    """(row, col) of the cells that are valid and within [-1, 1] at every one of two or more dates."""
    if len(dates) < 2:
        raise ValueError("a common mask takes two dates or more")
    valid = [d.where(raster.in_range(F.col(value))).select(*KEYS) for d in dates]
    return reduce(lambda a, b: a.join(b, KEYS, "left_semi"), valid)


def apply_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask, KEYS, "left_semi")


def require_cells(mask: DataFrame) -> DataFrame:
    if mask.isEmpty():
        raise ValueError("the dates share no valid cell")
    return mask


def valid_pixels(indexed: DataFrame) -> DataFrame:
    """Rows of a wide two-date relation that the common mask keeps: no join is needed there."""
    return indexed.where(raster.in_range(F.col("ndvi_base")) & raster.in_range(F.col("ndvi_target")))


def classified(pixels: DataFrame) -> DataFrame:
    """Pixels with delta, class_base, class_target and delta_class."""
    delta = raster.change(F.col("ndvi_base"), F.col("ndvi_target"))
    return pixels.withColumn("delta", delta).select(
        *KEYS,
        "ndvi_base",
        "ndvi_target",
        "delta",
        classify(F.col("ndvi_base"), INDEX_RULES).alias("class_base"),
        classify(F.col("ndvi_target"), INDEX_RULES).alias("class_target"),
        classify(F.col("delta"), CHANGE_RULES).alias("delta_class"),
    )
