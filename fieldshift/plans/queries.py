"""The registered raster queries: each operator on the dense raster, the cheap ones on the large sparse one too."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.grid import Grid, band_area, snap_down, snap_up
from ..functions.rules import CHANGE_RULES, INDEX_RULES, classify, single
from ..operators import alignment, allocation, clustering, focal, pixels, polygons, quality, regions, statistics
from ..sources import adapters
from ..sources.scratch import written
from .analysis import Analysis, forecast_of
from .oracles import TRIANGLE

Query = Callable[[SparkSession, str], DataFrame]


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return Analysis(pixels.index_from_bands(adapters.vector_bands(spark, sf_dir)), adapters.vector_grid(spark, sf_dir))


def _round(table: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    kinds = dict(table.dtypes)
    return table.select(
        *[F.round(F.col(c).cast("double"), own.get(c, digits)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in table.columns]
    )


def _of(make: Callable[[Analysis], DataFrame], digits: int = 6, **own: int) -> Query:
    return lambda spark, sf_dir: _round(make(analysis(spark, sf_dir)), digits, **own)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.index_from_bands(adapters.vector_bands(spark, sf_dir))


def common_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _indexed(spark, sf_dir)
    dates = [table.select("row", "col", F.col(c).alias("ndvi")) for c in ("ndvi_base", "ndvi_target")]
    return pixels.require_cells(pixels.common_mask(dates))


def masked_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _indexed(spark, sf_dir).select("row", "col", F.col("ndvi_base").alias("ndvi"))
    return _round(pixels.apply_mask(first, common_mask(spark, sf_dir)))


def ready_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _indexed(spark, sf_dir).select("row", "col", F.col("ndvi_base").alias("ndvi"))
    return _round(pixels.ready_index(stored, "ndvi"))


def ready_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.round(F.col("ndvi_base").cast("double") * 10_000).cast("float")
    return _round(pixels.ready_index(_indexed(spark, sf_dir).select("row", "col", x.alias("ndvi")), "ndvi"))


def scaled_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = adapters.vector_bands(spark, sf_dir)
    raw = F.when((F.col("row") + F.col("col")) % 7 == 0, single(-9999.05)).otherwise(F.col("red_base"))
    return _round(bands.select("row", "col", raster.unmasked(raw, raster.NODATA, 0.5, 0.25).alias("value")))


def classify_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [-1, 0.0999, 0.10, 0.25, 0.45, 0.65, 0.6501, 1, -0.2, -0.2001, -0.05, -0.0501, 0.05, 0.0499, 0.2, 0.1999]
    values = spark.createDataFrame([(float(v),) for v in edges], "value float")
    x = F.col("value")
    return _round(values.select("value", classify(x, INDEX_RULES).alias("ndvi_class"), classify(x, CHANGE_RULES).alias("delta_class")))


def row_area_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 0.001 degrees from 60 N down: the area of a cell differs by row."""
    rows = analysis(spark, sf_dir).pixels.groupBy("row").agg(F.count("*").alias("pixel_count"))
    north = F.lit(60.0) - F.col("row") * F.lit(0.001)
    south = F.lit(60.0) - (F.col("row") + 1) * F.lit(0.001)
    return rows.select("row", F.round(band_area(south, north, 0.001), 3).alias("cell_area"), "pixel_count")


def staged(a: Analysis) -> DataFrame:
    """Pixels with a scenario by fixed rules, for the queries that take scenarios as given."""
    delta, base, target = F.col("delta"), F.col("ndvi_base"), F.col("ndvi_target")
    scenario = (
        F.when((delta < single(-0.2)) & (base >= single(0.45)), "new_development")
        .when(delta < single(-0.05), "degradation")
        .when(target < single(0.25), "stable_urban")
        .when(target >= single(0.45), "stable_green")
        .otherwise("other")
    )
    return written(a.pixels.withColumn("scenario", scenario), "staged")


def _weights(a: Analysis) -> DataFrame:
    return polygons.influence_weights(a.features)


def _influence(a: Analysis) -> DataFrame:
    return written(polygons.influence(a.near, _weights(a), a.pixels, a.grid), "influence")


def _degraded(a: Analysis) -> tuple[DataFrame, DataFrame]:
    scored = allocation.degradation_scores(staged(a), _influence(a), a.grid)
    return allocation.degrade(scored, polygons.footprint(a.near), a.probabilities, a.grid.width)


def _able(a: Analysis) -> DataFrame:
    cells = staged(a)
    return allocation.recovery_capacity(cells, allocation.scenario_references(cells))


def recovered(a: Analysis) -> DataFrame:
    return allocation.recover(allocation.recovery_scores(_able(a), a.grid), a.probabilities, a.grid.width)[0]


def greened(a: Analysis) -> DataFrame:
    cells = staged(a)
    return allocation.greening(cells, allocation.scenario_references(cells), a.grid)


def staged_forecast(a: Analysis) -> DataFrame:
    table = forecast_of(staged(a), _influence(a), polygons.footprint(a.near), a.probabilities, a.grid)
    return table.select("row", "col", "scenario", "forecast")


def kmeans_predict(a: Analysis) -> DataFrame:
    two, ones = np.array([0.4, 0.4]), np.array([0.2, 0.2])
    fixed = clustering.Clusters(["ndvi_base", "ndvi_target"], two, two, ones, np.array([[-1, -1], [0, 0.5], [1, 1]]))
    return a.pixels.select("row", "col", fixed.label().cast("long").alias("cluster"))


def pixel_clusters(a: Analysis) -> DataFrame:
    """Per cluster of all pixels its statistics; the fit needs a driver sample, so SQL has no equal."""
    given = clustering.pixel_features(a.pixels)
    model = clustering.cluster(given, clustering.FEATURES, ["row", "col"])
    return clustering.pixel_cluster_statistics(given.withColumn("cluster", model.label()))


def snap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("vec_id") * F.lit(3.7)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", snap_down(value).cast("double").alias("snapped_down"), snap_up(value).cast("double").alias("snapped_up")
    )


def clip_polygon(a: Analysis) -> DataFrame:
    edges = alignment.rings_frame(a.pixels.sparkSession, [[TRIANGLE]])
    return alignment.clip(a.pixels.select("row", "col"), edges, a.grid)


def bilinear_resample(a: Analysis) -> DataFrame:
    target = Grid(a.grid.left + 3.0, a.grid.top - 4.0, 7.0, 7.0, 80, 90, a.grid.crs)
    cells = a.pixels.select("row", "col", F.col("ndvi_base").alias("value"))
    return alignment.resample(cells, a.grid, target).select("row", "col", F.col("value").cast("double").alias("value"))


def lonlat_centroid(a: Analysis) -> DataFrame:
    return regions.with_lonlat(a.largest, a.grid).select("change_type", "rank", "centroid_lon", "centroid_lat")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.classified(pixels.valid_pixels(pixels.index_from_bands(adapters.line_bands(spark, sf_dir))))


def line_change_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = regions.change_runs(_lines(spark, sf_dir))
    return runs.groupBy("delta_class").agg(F.count("*").alias("runs"), F.sum(F.col("last_col") - F.col("first_col") + 1).cast("long").alias("cells"))


def line_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = statistics.transition_matrix(_lines(spark, sf_dir), "class_base", "class_target", INDEX_RULES, 100.0)
    return matrix.where("pixel_count > 0").select("from_class", "to_class", "pixel_count")


def changed_pixels(a: Analysis) -> DataFrame:
    return allocation.changed_cells(forecast_of(staged(a), _influence(a), polygons.footprint(a.near), a.probabilities, a.grid))


def filled_features(a: Analysis) -> DataFrame:
    """Deviations of regions, those of single pixels being the median of the others."""
    zones = polygons.zonal_statistics(a.region_cells, a.pixels)
    return polygons.fill_with_medians(zones.select("region_id", "std_ndvi_base", "std_ndvi_target", "std_delta_ndvi"))


QUERIES: dict[str, Query] = {
    "ndvi_raw": lambda s, d: _round(_indexed(s, d)),
    "ndvi_class_areas": _of(lambda a: a.class_areas("class_base")),
    "ndvi_target_class_areas": _of(lambda a: a.class_areas("class_target")),
    "common_mask": common_mask,
    "masked_ndvi": masked_ndvi,
    "delta_ndvi": _of(lambda a: a.pixels.select("row", "col", "delta")),
    "ndvi_classes": _of(lambda a: a.pixels.select("row", "col", "class_base", "class_target")),
    "delta_classes": _of(lambda a: a.pixels.select("row", "col", "delta_class")),
    "ndvi_ready_float": ready_float,
    "ndvi_ready_int16": ready_int16,
    "scaled_band": scaled_band,
    "classify_boundaries": classify_boundaries,
    "value_stats": _of(lambda a: a.value_statistics),
    "delta_class_areas": _of(lambda a: a.class_areas("delta_class")),
    "transition_matrix": _of(lambda a: a.transitions),
    "transition_probabilities": _of(lambda a: a.probabilities),
    "display_range": _of(lambda a: statistics.display_range(a.pixels, ["ndvi_base", "ndvi_target"], 0.05, 0.99)),
    "delta_display_range": _of(lambda a: statistics.display_range(a.pixels, ["delta"], 0.02, 0.98, True)),
    "row_area_model": row_area_model,
    "change_runs": _of(lambda a: regions.change_runs(a.pixels)),
    "change_run_links": _of(lambda a: regions.run_links(regions.change_runs(a.pixels))),
    "change_components": _of(lambda a: a.run_regions.select("run_id", "region_id")),
    "largest_changes": _of(
        lambda a: a.largest.select(
            "change_type", "delta_class", "area_m2", "area_ha", "bbox_min_x", "bbox_min_y", "bbox_max_x", "bbox_max_y", F.col("rank").cast("long").alias("rank")
        )
    ),
    "component_perimeter": _of(lambda a: polygons.perimeters(a.region_cells, a.grid)),
    "nearest_component": _of(lambda a: polygons.nearest_regions(a.largest), 4),
    "context_distance": _of(lambda a: polygons.context_distance(a.largest), 4),
    "region_geometry": _of(
        lambda a: a.geometry.select("region_id", "compactness", "area_perimeter_ratio", "equivalent_radius", "neighbour_polygon_count", "reach"), reach=4
    ),
    "region_eccentricity": _of(lambda a: polygons.eccentricities(a.region_cells, a.grid)),
    "buffer_footprint": _of(lambda a: polygons.footprint(a.near)),
    "zonal_stats": _of(
        lambda a: polygons.zonal_statistics(a.region_cells, a.pixels).select(
            "region_id", "valid_pixel_count", "mean_ndvi_base", "median_ndvi_target", "std_delta_ndvi", "min_delta_ndvi", "max_delta_ndvi", "class_1_share", "class_3_share"
        )
    ),
    "zonal_more": _of(
        lambda a: polygons.zonal_statistics(a.region_cells, a.pixels).select(
            "region_id", "median_ndvi_base", "median_delta_ndvi", "mean_ndvi_target", "mean_delta_ndvi", "std_ndvi_base", "std_ndvi_target",
            "min_ndvi_base", "max_ndvi_base", "min_ndvi_target", "max_ndvi_target", "class_2_share", "class_4_share", "class_5_share",
        )
    ),
    "filled_features": _of(filled_features),
    "context_ring": _of(lambda a: polygons.context_features(a.near, a.largest, a.pixels, a.grid)),
    "forecast_weights": _of(_weights),
    "influence_surface": _of(_influence),
    "mean_loss": _of(lambda a: polygons.mean_loss(a.region_cells, a.pixels)),
    "local_mean_5x5": _of(lambda a: focal.local_mean(a.pixels, a.grid, F.col("ndvi_target"))),
    "local_std_5x5": _of(lambda a: focal.local_deviation(a.pixels, a.grid, F.col("ndvi_target")), 4),
    "scenario_references": _of(lambda a: allocation.scenario_references(staged(a))),
    "recovery_capacity": _of(lambda a: _able(a).select("row", "col", "capacity")),
    "degradation_quota": _of(lambda a: _degraded(a)[0]),
    "degradation_requests": _of(lambda a: _degraded(a)[1].select("from_class", "to_class", "probability", "requested")),
    "recovery_quota": _of(recovered),
    "urban_greening": _of(greened),
    "scenario_summary": _of(lambda a: statistics.scenario_summary(staged(a), a.grid.cell_area)),
    "staged_forecast": _of(staged_forecast, 5),
    "changed_pixels": _of(changed_pixels),
    "kmeans_predict": _of(kmeans_predict),
    "pixel_clusters": _of(pixel_clusters),
    "region_clusters": _of(lambda a: a.region_model[1]),
    "land_dynamics": _of(lambda a: a.scenarios.select("row", "col", "scenario")),
    "forecast": _of(lambda a: a.forecast.select("row", "col", "scenario", "ndvi_target", "forecast")),
    "snap_grid": snap_grid,
    "clip_polygon": _of(clip_polygon),
    "bilinear_resample": _of(bilinear_resample, 5),
    "lonlat_centroid": _of(lonlat_centroid, 7),
    "quality_report": _of(lambda a: a.checks),
    "band_metadata": lambda s, d: _round(quality.band_metadata(adapters.vector_bands(s, d), "red_base", adapters.vector_grid(s, d))),
    "line_class_areas": lambda s, d: _round(statistics.class_areas(_lines(s, d), "class_base", INDEX_RULES, 100.0)),
    "line_transition_matrix": line_transitions,
    "line_value_stats": lambda s, d: _round(statistics.value_statistics(_lines(s, d), ["ndvi_base", "ndvi_target"])),
    "line_change_runs": line_change_runs,
}
