"""Moving window means and deviations over the dense grid.

A window repeats edge cells beyond the grid. It is separable: sums go along rows, then along columns, each by a window
function over one line of cells, padded with copies of its ends.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid

SIZE = 5


def dense(cells: DataFrame, grid: Grid) -> DataFrame:
    """Every cell of the grid, with nulls where ``cells`` has none."""
    spark = cells.sparkSession
    every = spark.range(grid.height).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("col"))
    return every.join(cells, ["row", "col"], "left")


def _along(table: DataFrame, line: str, place: str, last: int, sums: list[str], reach: int) -> DataFrame:
    copies = (
        F.when(F.col(place) == 0, F.sequence(F.lit(-reach), F.lit(0)))
        .when(F.col(place) == last, F.sequence(F.lit(last), F.lit(last + reach)))
        .otherwise(F.array(F.col(place)))
    )
    if last == 0:
        copies = F.sequence(F.lit(-reach), F.lit(reach))
    padded = table.withColumn("_at", F.explode(copies))
    frame = Window.partitionBy(line).orderBy("_at").rangeBetween(-reach, reach)
    return padded.select("row", "col", "_at", *[F.sum(s).over(frame).alias(s) for s in sums]).where(F.col("_at") == F.col(place)).drop("_at")


def window_means(cells: DataFrame, grid: Grid, values: Mapping[str, Column], valid: Column, size: int = SIZE) -> DataFrame:
    """(row, col, one column per value) at every cell of the grid: the mean over the window's valid cells, 0 without one."""
    names = list(values)
    known = cells.select("row", "col", valid.cast("double").alias("_n"), *[F.when(valid, v.cast("double")).alias(n) for n, v in values.items()])
    table = dense(known, grid).fillna(0.0)
    reach, sums = size // 2, ["_n", *names]
    table = _along(table, "row", "col", grid.width - 1, sums, reach)
    table = _along(table, "col", "row", grid.height - 1, sums, reach)
    return table.select("row", "col", *[F.when(F.col("_n") > 0, F.col(n) / F.nullif(F.col("_n"), F.lit(0.0))).otherwise(0.0).alias(n) for n in names])


def local_mean(cells: DataFrame, grid: Grid, value: Column, valid: Column | None = None, size: int = SIZE) -> DataFrame:
    return window_means(cells, grid, {"local_mean": value}, F.lit(True) if valid is None else valid, size)


def local_deviation(cells: DataFrame, grid: Grid, value: Column, valid: Column | None = None, size: int = SIZE) -> DataFrame:
    x = value.cast("double")
    both = window_means(cells, grid, {"m": x, "s": x * x}, F.lit(True) if valid is None else valid, size)
    return both.select("row", "col", F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0))).alias("local_std"))
