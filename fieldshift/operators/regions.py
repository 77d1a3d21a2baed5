"""Regions of equal change class: runs of cells, links between them, 4-connected components, and the largest ones.

Cells become row runs, runs touch those in the next row, and the small run graph is what components are found on. Runs
of one row need the row's cells in order, nothing needs the whole raster in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid, from_utm
from ..functions.rules import GAIN_CLASSES, LOSS_CLASSES
from ..sources.scratch import written

#: Regions that are kept of each type.
MOST_REGIONS = 20
#: With no more run links than this, components are found on the driver, else by rounds in the cluster.
MOST_LOCAL_LINKS = 200_000


def change_runs(cells: DataFrame, column: str = "delta_class") -> DataFrame:
    """(run_id, row, first_col, last_col, delta_class): longest stretches of cells of one changed class in a row."""
    changed = cells.where(F.col(column).isin(*LOSS_CLASSES, *GAIN_CLASSES))
    order = Window.partitionBy("row", column).orderBy("col")
    island = changed.select("row", "col", F.col(column).alias("delta_class"), (F.col("col") - F.row_number().over(order)).alias("island"))
    runs = island.groupBy("row", "delta_class", "island").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"))
    return runs.select(
        (F.col("row").cast("long") * F.lit(1 << 32) + F.col("first_col")).alias("run_id"), "row", "first_col", "last_col", "delta_class"
    )


def run_links(runs: DataFrame) -> DataFrame:
    """(upper, lower): runs of one class in neighbouring rows whose columns overlap. The join is on class and row."""
    a, b = runs.alias("a"), runs.alias("b")
    return a.join(
        b,
        (F.col("a.delta_class") == F.col("b.delta_class"))
        & (F.col("a.row") + 1 == F.col("b.row"))
        & (F.col("a.first_col") <= F.col("b.last_col"))
        & (F.col("b.first_col") <= F.col("a.last_col")),
    ).select(F.col("a.run_id").alias("upper"), F.col("b.run_id").alias("lower"))


def _locally(spark: SparkSession, links: list) -> DataFrame:
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return spark.createDataFrame([(i, root(i)) for i in list(parent)], "run_id long, region_id long")


def _in_rounds(links: DataFrame, most: int = 200) -> DataFrame:
    """Smallest reachable run by rounds: take the lowest label around, then the label of the label."""
    both = written(links.toDF("a", "b").unionByName(links.toDF("b", "a")).distinct())
    now = written(both.groupBy(F.col("a").alias("run_id")).agg(F.least(F.min("b"), F.first("a")).alias("region_id")))
    for _ in range(most):
        around = both.join(now, both.b == now.run_id).groupBy("a").agg(F.min("region_id").alias("low"))
        lower = now.join(around, now.run_id == around.a).select("run_id", F.least("region_id", "low").alias("region_id"))
        label = lower.toDF("label", "jump")
        jumped = lower.join(label, lower.region_id == label.label).select("run_id", F.least("region_id", "jump").alias("region_id"))
        fresh = written(jumped)
        moved = fresh.join(now.withColumnRenamed("region_id", "old"), "run_id").where("region_id <> old").isEmpty()
        now = fresh
        if moved:
            return now
    raise RuntimeError("regions did not settle")


def regions_of_runs(runs: DataFrame, most_local: int = MOST_LOCAL_LINKS) -> DataFrame:
    """Runs with region_id, the smallest run_id of their 4-connected region."""
    links = run_links(runs)
    head = links.take(most_local + 1)
    found = _locally(runs.sparkSession, [tuple(r) for r in head]) if len(head) <= most_local else _in_rounds(links)
    return runs.join(found, "run_id", "left").withColumn("region_id", F.coalesce("region_id", "run_id"))


def region_table(run_regions: DataFrame, grid: Grid) -> DataFrame:
    """Per region: type, class, cells, area, outer edges, and the mean cell centre. Sums over runs suffice."""
    n = F.col("last_col") - F.col("first_col") + 1
    middle = (F.col("first_col") + F.col("last_col")) / 2
    sums = run_regions.groupBy("region_id", "delta_class").agg(
        F.sum(n).alias("pixel_count"),
        F.min("row").alias("min_row"),
        F.max("row").alias("max_row"),
        F.min("first_col").alias("min_col"),
        F.max("last_col").alias("max_col"),
        F.sum(n * F.col("row")).alias("_rows"),
        F.sum(n * middle).alias("_cols"),
    )
    x0, y0, cx, cy = (F.lit(v) for v in (grid.left, grid.top, grid.cell_x, grid.cell_y))
    return sums.select(
        "region_id",
        F.when(F.col("delta_class").isin(*LOSS_CLASSES), F.lit("degradation")).otherwise(F.lit("improvement")).alias("change_type"),
        "delta_class",
        F.col("pixel_count").cast("long").alias("pixel_count"),
        (F.col("pixel_count") * grid.cell_area).alias("area_m2"),
        (F.col("pixel_count") * (grid.cell_area / 10_000)).alias("area_ha"),
        (x0 + F.col("min_col") * cx).alias("bbox_min_x"),
        (y0 - (F.col("max_row") + 1) * cy).alias("bbox_min_y"),
        (x0 + (F.col("max_col") + 1) * cx).alias("bbox_max_x"),
        (y0 - F.col("min_row") * cy).alias("bbox_max_y"),
        (x0 + (F.col("_cols") / F.col("pixel_count") + 0.5) * cx).alias("centre_x"),
        (y0 - (F.col("_rows") / F.col("pixel_count") + 0.5) * cy).alias("centre_y"),
        "min_row",
        "min_col",
    )


def largest_regions(table: DataFrame, most: int = MOST_REGIONS) -> DataFrame:
    """The ``most`` largest regions of each type with their rank; ties go by class, then upper left cell."""
    order = Window.partitionBy("change_type").orderBy(F.desc("area_m2"), "delta_class", "min_row", "min_col")
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def with_lonlat(table: DataFrame, grid: Grid) -> DataFrame:
    """Adds centroid_lon and centroid_lat, the geographic position of the mean cell centre."""
    crs = grid.crs

    def locate(frames):
        for frame in frames:
            lon, lat = from_utm(frame["centre_x"].to_numpy(float), frame["centre_y"].to_numpy(float), crs)
            yield frame.assign(centroid_lon=lon, centroid_lat=lat)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInPandas(locate, f"{fields}, centroid_lon double, centroid_lat double")


def region_cells(run_regions: DataFrame, chosen: DataFrame) -> DataFrame:
    """(region_id, row, col) of the chosen regions."""
    return run_regions.join(chosen.select("region_id"), "region_id", "left_semi").select(
        "region_id", "row", F.explode(F.sequence("first_col", "last_col")).alias("col")
    )
