"""Bringing rasters onto one grid and inside one boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid, project

Ring = Sequence[tuple[float, float]]


def rings_frame(spark: SparkSession, polygons: Sequence[Sequence[Ring]]) -> DataFrame:
    """(polygon, ring, x1, y1, x2, y2): the edges of polygons, each a list of rings, holes among them."""
    edges = []
    for p, rings in enumerate(polygons):
        for r, ring in enumerate(rings):
            points = list(ring) if tuple(ring[0]) == tuple(ring[-1]) else [*ring, ring[0]]
            edges += [(p, r, *map(float, (*a, *b))) for a, b in zip(points, points[1:])]
    return spark.createDataFrame(edges, "polygon int, ring int, x1 double, y1 double, x2 double, y2 double")


def polygon_areas(edges: DataFrame) -> DataFrame:
    """(polygon, area): the outer ring less the holes, by the shoelace rule."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    ring = edges.groupBy("polygon", "ring").agg(F.abs(twice / 2).alias("a"))
    sign = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    return ring.groupBy("polygon").agg(F.sum(F.col("a") * sign).alias("area"))


def inside_spans(edges: DataFrame, grid: Grid) -> DataFrame:
    """(row, from_x, to_x): where each row's centre line is inside a polygon, by the even-odd rule.

    Every edge is dealt to the rows whose centre line it crosses; sorted crossings of a row pair up.
    """
    top, size = F.lit(grid.top), F.lit(grid.cell_y)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.ceil((top - high) / size - 0.5), F.lit(0)).cast("int")
    last = F.least(F.floor((top - low) / size - 0.5), F.lit(grid.height - 1)).cast("int")
    rows = edges.withColumn("first", first).withColumn("last", last).where("first <= last")
    rows = rows.withColumn("row", F.explode(F.sequence("first", "last")))
    y = grid.y(F.col("row"))
    met = rows.where((low <= y) & (y < high))
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    order = Window.partitionBy("polygon", "row").orderBy("x")
    crossings = met.select("polygon", "row", x.alias("x"))
    paired = crossings.select("polygon", "row", F.col("x").alias("from_x"), F.lead("x").over(order).alias("to_x"), F.row_number().over(order).alias("n"))
    return paired.where("n % 2 = 1").select("row", "from_x", "to_x")


def clip(cells: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """The cells whose centres are inside. Spans join on the row, with the column range as residual."""
    spans, x = inside_spans(edges, grid), grid.x(F.col("col"))
    return cells.join(spans, (cells.row == spans.row) & (x >= F.col("from_x")) & (x < F.col("to_x")), "left_semi")


def cropped(cells: DataFrame) -> DataFrame:
    """One row: the extent in rows and columns that cells take up."""
    return cells.agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))


def _sources(targets: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Targets with their centre (sx, sy) in the source's coordinates."""
    placed = targets.withColumn("sx", target.x(F.col("col"))).withColumn("sy", target.y(F.col("row")))
    if source.crs == target.crs:
        return placed
    here, there = target.crs, source.crs
    project([500000.0], [0.0], here, there)  # an unknown system is told before any task runs

    def locate(frames):
        for frame in frames:
            x, y = project(frame["sx"].to_numpy(float), frame["sy"].to_numpy(float), here, there)
            yield frame.assign(sx=x, sy=y)

    return placed.mapInPandas(locate, placed.schema)


def resample(cells: DataFrame, source: Grid, target: Grid, value: str = "value") -> DataFrame:
    """(row, col, value) on the target grid: bilinear, with weights over the valid ones of the four source cells.

    A target cell without a valid source cell is absent. Each target cell asks for four source cells by an equi join.
    """
    spark = cells.sparkSession
    targets = spark.range(target.height).select(
        F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(target.width - 1))).alias("col")
    )
    placed = _sources(targets, source, target)
    fx = (F.col("sx") - source.left) / source.cell_x - 0.5
    fy = (F.lit(source.top) - F.col("sy")) / source.cell_y - 0.5
    at = placed.withColumn("fx", fx).withColumn("fy", fy).withColumn("c", F.floor("fx").cast("int")).withColumn("r", F.floor("fy").cast("int"))
    wx, wy = F.col("fx") - F.col("c"), F.col("fy") - F.col("r")
    four = F.array(
        *[
            F.struct((F.col("r") + i).alias("sr"), (F.col("c") + j).alias("sc"), ((wy if i else 1 - wy) * (wx if j else 1 - wx)).alias("w"))
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    asked = at.select("row", "col", F.explode(four).alias("q")).select("row", "col", "q.*").where("w > 0")
    known = cells.where(F.col(value).isNotNull()).select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).cast("double").alias("v"))
    return (
        asked.join(known, ["sr", "sc"])
        .groupBy("row", "col")
        .agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).cast("float").alias(value))
    )


def aligned_bands(bands: DataFrame, source: Grid, target: Grid, edges: DataFrame) -> DataFrame:
    """(band, row, col, value) of several bands, resampled and clipped in one job each: bands are a key, not a loop."""
    names = [r.band for r in bands.select("band").distinct().collect()]
    parts = [
        clip(resample(bands.where(F.col("band") == name), source, target), edges, target).withColumn("band", F.lit(name)) for name in sorted(names)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
