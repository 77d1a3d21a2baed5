"""Features of change regions: geometry, values inside, values around, weights. The chosen regions are few."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.grid import Grid
from ..functions.rules import INDEX_RULES
from ..sources.scratch import written
from .ranks import medians, percentiles_of_all

# What a region's influence is made of.
WEIGHTS = {
    "area_m2": 0.35,
    "mean_delta_ndvi": 0.30,
    "neighbour_polygon_count": 0.15,
    "compactness": 0.10,
    "surrounding_mean_delta_ndvi": 0.10,
}
STEP = raster.FLOAT_STEP


def perimeters(cells: DataFrame, grid: Grid) -> DataFrame:
    """(region_id, perimeter_m): sides of cells that face out of their region, holes included."""
    sides = [(0, 1, grid.cell_y), (0, -1, grid.cell_y), (1, 0, grid.cell_x), (-1, 0, grid.cell_x)]
    faces = cells.select(
        "region_id",
        F.explode(
            F.array(
                *[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(abs(size)).alias("size")) for dr, dc, size in sides]
            )
        ).alias("f"),
    ).select("region_id", "f.*")
    return faces.join(cells, ["region_id", "row", "col"], "left_anti").groupBy("region_id").agg(F.sum("size").alias("perimeter_m"))


def centre_distances(regions: DataFrame) -> DataFrame:
    """(region_id, other, distance) between the centres of the chosen regions, at most 40 by 40 rows."""
    a = regions.select("region_id", F.col("centre_x").alias("x"), F.col("centre_y").alias("y"))
    b = regions.select(F.col("region_id").alias("other"), F.col("centre_x").alias("ox"), F.col("centre_y").alias("oy"))
    gap = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    return a.join(F.broadcast(b), F.col("region_id") != F.col("other")).select("region_id", "other", gap.alias("distance"))


def nearest_regions(regions: DataFrame) -> DataFrame:
    """(region_id, nearest): distance to the nearest other centre, 0 without one."""
    near = centre_distances(regions).groupBy("region_id").agg(F.min("distance").alias("nearest"))
    return regions.select("region_id").join(near, "region_id", "left").select("region_id", F.coalesce("nearest", F.lit(0.0)).alias("nearest"))


def radius(area: Column) -> Column:
    return F.sqrt(F.greatest(area, F.lit(0.0)) / F.lit(math.pi))


def context_distance(regions: DataFrame) -> DataFrame:
    """One row: the median of all equivalent radii and positive nearest distances together."""
    values = regions.select(radius(F.col("area_m2")).alias("v")).unionAll(nearest_regions(regions).where("nearest > 0").select("nearest"))
    return values.agg(F.coalesce(F.median("v"), F.lit(0.0)).alias("context_distance"))


def geometry_features(regions: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """Per region: perimeter, compactness, area by perimeter, nearest distance, neighbours in context, radius, reach.

    ``reach`` is how far a region bears on its surroundings: its radius stretched by its shape, or the context distance.
    """
    near, gaps = nearest_regions(regions), centre_distances(regions)
    context = context_distance(regions)
    counts = (
        gaps.crossJoin(F.broadcast(context))
        .where("distance <= context_distance")
        .groupBy("region_id")
        .agg(F.count("*").cast("double").alias("neighbour_polygon_count"))
    )
    area, around = F.col("area_m2"), F.col("perimeter_m")
    compact = F.lit(4 * math.pi) * area / F.greatest(around * around, F.lit(STEP))
    stretch = F.lit(1.0) / F.greatest(F.sqrt(F.greatest(compact, F.lit(STEP))), F.lit(STEP))
    return (
        regions.select("region_id", "area_m2")
        .join(perimeters(cells, grid), "region_id")
        .join(near, "region_id")
        .join(counts, "region_id", "left")
        .crossJoin(F.broadcast(context))
        .select(
            "region_id",
            "area_m2",
            "perimeter_m",
            compact.alias("compactness"),
            (area / F.greatest(around, F.lit(STEP))).alias("area_perimeter_ratio"),
            F.col("nearest").alias("distance_to_nearest_polygon"),
            F.coalesce("neighbour_polygon_count", F.lit(0.0)).alias("neighbour_polygon_count"),
            radius(area).alias("equivalent_radius"),
            F.greatest(radius(area) * stretch, F.col("context_distance")).alias("reach"),
        )
    )


def smallest_rectangle(points: np.ndarray) -> float:
    """Long by short side of the least-area rectangle around points, by the edges of their hull; 0 if it is flat."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return 0.0

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and np.linalg.det(np.array([out[-1] - out[-2], p - out[-2]])) <= 1e-12:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(half(points) + half(points[::-1]))
    if len(hull) < 3:
        return 0.0
    best, sides = np.inf, (0.0, 0.0)
    for edge in np.diff(np.vstack([hull, hull[:1]]), axis=0):
        u = edge / np.hypot(*edge)
        a, b = np.ptp(hull @ u), np.ptp(hull @ np.array([-u[1], u[0]]))
        if a * b < best - 1e-9:
            best, sides = a * b, (a, b)
    long, short = max(sides), min(sides)
    return 0.0 if short <= STEP else float(long / short)


def eccentricities(cells: DataFrame, grid: Grid) -> DataFrame:
    """(region_id, eccentricity) from the ends of a region's rows, which hold its hull: few per region."""
    ends = cells.groupBy("region_id", "row").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    cx, cy = grid.cell_x, grid.cell_y

    def measure(frame):
        corners = np.array(
            [(c * cx, -r * cy) for row, a, b in zip(frame["row"], frame["a"], frame["b"]) for r in (row, row + 1) for c in (a, b + 1)], float
        )
        import pandas as pd

        return pd.DataFrame({"region_id": [frame["region_id"].iloc[0]], "eccentricity": [smallest_rectangle(corners)]})

    return ends.groupBy("region_id").applyInPandas(measure, "region_id long, eccentricity double")


def zonal_statistics(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per region: count; mean, median, sample deviation, least and largest of both dates and the change; class shares."""
    inside = written(pixels.join(cells, ["row", "col"]), "inside")
    aggregates = [F.count("*").alias("valid_pixel_count")]
    for column, name in (("ndvi_base", "ndvi_base"), ("ndvi_target", "ndvi_target"), ("delta", "delta_ndvi")):
        x = F.col(column).cast("double")
        aggregates += [
            F.avg(x).alias(f"mean_{name}"),
            F.when(F.count(x) > 1, F.stddev_samp(x)).alias(f"std_{name}"),
            F.min(x).alias(f"min_{name}"),
            F.max(x).alias(f"max_{name}"),
        ]
    aggregates += [
        F.avg((F.col("class_target") == r.class_id).cast("double")).alias(f"class_{r.class_id}_share") for r in INDEX_RULES
    ]
    names = {"ndvi_base": "median_ndvi_base", "ndvi_target": "median_ndvi_target", "delta": "median_delta_ndvi"}
    middle = medians(inside, ["region_id"], list(names), stored=True).withColumnsRenamed(names)
    return inside.groupBy("region_id").agg(*aggregates).join(F.broadcast(middle), "region_id", "left")


#: Rows of cells whose distances one call of Python works out.
BAND = 16


def around(cells: DataFrame, reach: DataFrame, grid: Grid) -> DataFrame:
    """(region_id, row, col, reach, square_gap, centre_gap): cells within each region's reach of its area.

    ``square_gap`` is the distance from a cell's centre to the region's area, ``centre_gap`` to its nearest cell centre,
    both in metres. Distances separate: down each column of a region every row in reach learns how many rows the nearest
    cell of that column is away, once; along each row the nearest column then follows from those numbers. So there is
    one row per cell in reach, not one per pair of cells.
    """
    far = reach.select("region_id", "reach")
    over = Window.partitionBy("region_id", "col").orderBy("row")
    runs = cells.select("region_id", "row", "col", (F.col("row") - F.row_number().over(over)).alias("g"))
    runs = runs.groupBy("region_id", "col", "g").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    over = Window.partitionBy("region_id", "col").orderBy("a")
    rows = F.ceil(F.col("reach") / grid.cell_y + 1).cast("int")
    # a run's rows end where the next run is nearer; the row halfway goes to the upper one
    before, after = F.lag("b").over(over), F.lead("a").over(over)
    first = F.greatest(F.col("a") - F.col("rows"), F.lit(0), F.coalesce(F.floor((before + F.col("a")) / 2).cast("int") + 1, F.lit(0)))
    last = F.least(F.col("b") + F.col("rows"), F.lit(grid.height - 1), F.coalesce(F.floor((F.col("b") + after) / 2).cast("int"), F.lit(grid.height - 1)))
    down = (
        runs.join(F.broadcast(far), "region_id")
        .withColumn("rows", rows)
        .select("region_id", "reach", "col", "a", "b", first.alias("first"), last.alias("last"))
        .where("first <= last")
        .select("region_id", "reach", "col", "a", "b", F.explode(F.sequence("first", "last")).alias("row"))
        .select("region_id", "reach", "row", "col", F.greatest(F.col("a") - F.col("row"), F.col("row") - F.col("b"), F.lit(0)).alias("steps"))
    )
    cx, cy, width = grid.cell_x, grid.cell_y, grid.width

    def across(table):
        import pyarrow as pa

        region, reached = table.column("region_id")[0].as_py(), table.column("reach")[0].as_py()
        row, col, steps = (table.column(c).to_numpy() for c in ("row", "col", "steps"))
        most = math.ceil(reached / cx + 1)
        left, right = max(0, int(col.min()) - most), min(width - 1, int(col.max()) + most)
        top = int(row.min())
        shape = int(row.max()) - top + 1, right - left + 1
        up_square, up_centre = (np.full(shape, np.inf) for _ in range(2))
        up_square[row - top, col - left] = (np.maximum(steps - 0.5, 0.0) * cy) ** 2
        up_centre[row - top, col - left] = (steps * cy) ** 2
        square, centre = np.full(shape, np.inf), np.full(shape, np.inf)
        for d in range(min(most, shape[1] - 1) + 1):
            gap_square, gap_centre = (max(d - 0.5, 0.0) * cx) ** 2, (d * cx) ** 2
            for to, of in ((slice(d, None), slice(None, shape[1] - d)), (slice(None, shape[1] - d), slice(d, None))):
                np.minimum(square[:, to], up_square[:, of] + gap_square, out=square[:, to])
                np.minimum(centre[:, to], up_centre[:, of] + gap_centre, out=centre[:, to])
        square, centre = np.sqrt(square), np.sqrt(centre)
        r, c = np.nonzero(square <= reached)
        full = lambda v, t: pa.array(np.full(len(r), v), t)
        return pa.table({
            "region_id": full(region, pa.int64()), "row": pa.array((r + top).astype(np.int32)), "col": pa.array((c + left).astype(np.int32)),
            "reach": full(reached, pa.float64()), "square_gap": pa.array(square[r, c]), "centre_gap": pa.array(centre[r, c]),
        })

    bands = down.withColumn("band", F.floor(F.col("row") / BAND).cast("int"))
    return bands.groupBy("region_id", "band").applyInArrow(across, "region_id long, row int, col int, reach double, square_gap double, centre_gap double")


def context_features(near: DataFrame, regions: DataFrame, pixels: DataFrame, grid: Grid) -> DataFrame:
    """Per region, over valid pixels around it but not in it: mean index, mean change, area by green area around.

    Green is at or above the median index of all pixels. A region without such pixels has nulls.
    """
    middle = percentiles_of_all(pixels, F.col("ndvi_target"), [0.5]).select(F.col("p")[0].alias("green_from"))
    ring = near.where("centre_gap > 0").join(pixels.select("row", "col", "ndvi_target", "delta"), ["row", "col"]).crossJoin(F.broadcast(middle))
    sums = ring.groupBy("region_id").agg(
        F.avg(F.col("ndvi_target").cast("double")).alias("surrounding_mean_ndvi"),
        F.avg(F.col("delta").cast("double")).alias("surrounding_mean_delta_ndvi"),
        F.sum((F.col("ndvi_target") >= F.col("green_from")).cast("int")).alias("green"),
    )
    ratio = F.col("area_m2") / F.greatest(F.col("green") * grid.cell_area, F.lit(grid.cell_area))
    return (
        regions.select("region_id", "area_m2")
        .join(sums, "region_id", "left")
        .select("region_id", "surrounding_mean_ndvi", "surrounding_mean_delta_ndvi", ratio.alias("surrounding_green_area_ratio"))
    )


def fill_with_medians(features: DataFrame, keys: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """Missing and non-finite numbers become their column's median, or 0 where a column has none."""
    columns = [f.name for f in features.schema if f.name not in keys and f.dataType.typeName() in ("double", "float", "long", "integer")]
    clean = features.select(
        *keys, *[F.when(raster.finite(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]
    )
    middles = clean.agg(*[F.median(c).alias(f"_{c}") for c in columns])
    return clean.crossJoin(F.broadcast(middles)).select(*keys, *[F.coalesce(c, f"_{c}", F.lit(0.0)).alias(c) for c in columns])


def influence_weights(features: DataFrame) -> DataFrame:
    """(region_id, forecast_weight): weighted sum of features, each over its largest; an absent feature counts 0."""
    used = [c for c in WEIGHTS if c in features.columns]
    size = {c: F.abs(F.col(c)) if "delta" in c else F.col(c) for c in used}
    largest = features.agg(*[F.max(F.coalesce(size[c], F.lit(0.0))).alias(f"_{c}") for c in used])
    total = sum((F.lit(WEIGHTS[c]) * raster.share_of_max(size[c], F.col(f"_{c}")) for c in used), F.lit(0.0))
    return features.crossJoin(F.broadcast(largest)).select("region_id", total.alias("forecast_weight"))


def influence(near: DataFrame, weights: DataFrame, pixels: DataFrame, grid: Grid) -> DataFrame:
    """(row, col, influence): at each valid pixel the largest of weight times linear decay over the regions in reach."""
    steps = F.greatest(F.col("reach") / F.lit(max(grid.cell_size, STEP)), F.lit(1.0))
    decay = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("centre_gap") / F.lit(grid.cell_size) / steps))
    surface = (
        near.join(F.broadcast(weights), "region_id")
        .where(F.col("forecast_weight") > STEP)
        .groupBy("row", "col")
        .agg(F.max(F.col("forecast_weight") * decay).alias("influence"))
    )
    return pixels.select("row", "col").join(surface, ["row", "col"], "left").select("row", "col", F.coalesce("influence", F.lit(0.0)).alias("influence"))


def footprint(near: DataFrame) -> DataFrame:
    """(row, col) of all cells in reach of some region."""
    return near.select("row", "col").distinct()


def mean_loss(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """One row: the size of the mean change of losing pixels inside regions, 0 without one."""
    inside = pixels.join(cells.select("row", "col").distinct(), ["row", "col"], "left_semi")
    loss = F.avg(F.when(F.col("delta") < 0, F.col("delta").cast("double")))
    return inside.agg(F.abs(F.coalesce(loss, F.lit(0.0))).alias("mean_loss"))
