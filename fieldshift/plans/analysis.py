"""The whole analysis as one lazy plan: every table is a DataFrame, computed when it is asked for."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.rules import CHANGE_RULES, INDEX_RULES
from ..operators import allocation, clustering, pixels, polygons, quality, regions, statistics
from ..sources.scratch import few, written

#: Regions that are kept of both types.
MOST = 2 * regions.MOST_REGIONS


@dataclass
class Analysis:
    """Tables of a two-date raster, from (row, col, ndvi_base, ndvi_target); the years name outputs only.

    The driver sees the features of at most 40 regions, a sample of at most 1200 pixels and a few scalars.
    """

    indexed: DataFrame
    grid: Grid
    base_year: int = 2015
    target_year: int = 2025
    forecast_year: int = 2035
    leak: bool = True
    names: Mapping[str, str] = field(default_factory=dict)

    @cached_property
    def pixels(self) -> DataFrame:
        return pixels.classified(pixels.valid_pixels(self.indexed))

    @cached_property
    def value_statistics(self) -> DataFrame:
        return statistics.value_statistics(self.pixels, ["ndvi_base", "ndvi_target", "delta"])

    def class_areas(self, column: str) -> DataFrame:
        return statistics.class_areas(self.pixels, column, CHANGE_RULES if column == "delta_class" else INDEX_RULES, self.grid.cell_area)

    @cached_property
    def transitions(self) -> DataFrame:
        return statistics.transition_matrix(self.pixels, "class_base", "class_target", INDEX_RULES, self.grid.cell_area)

    @cached_property
    def probabilities(self) -> DataFrame:
        return few(statistics.transition_probabilities(self.transitions, INDEX_RULES), len(INDEX_RULES) ** 2)

    @cached_property
    def run_regions(self) -> DataFrame:
        return written(regions.regions_of_runs(written(regions.change_runs(self.pixels), "runs")), "run-regions")

    @cached_property
    def region_table(self) -> DataFrame:
        return regions.region_table(self.run_regions, self.grid)

    @cached_property
    def largest(self) -> DataFrame:
        return few(regions.largest_regions(self.region_table), MOST)

    @cached_property
    def region_cells(self) -> DataFrame:
        return written(regions.region_cells(self.run_regions, self.largest), "region-cells")

    @cached_property
    def geometry(self) -> DataFrame:
        return few(polygons.geometry_features(self.largest, self.region_cells, self.grid), MOST)

    @cached_property
    def near(self) -> DataFrame:
        return written(polygons.around(self.region_cells, self.geometry, self.grid), "near")

    @cached_property
    def features(self) -> DataFrame:
        """One filled row per chosen region."""
        parts = [
            polygons.eccentricities(self.region_cells, self.grid),
            polygons.zonal_statistics(self.region_cells, self.pixels),
            polygons.context_features(self.near, self.largest, self.pixels, self.grid),
        ]
        table = self.geometry.drop("reach")
        for part in parts:
            table = table.join(part, "region_id", "left")
        return few(polygons.fill_with_medians(few(table, MOST)), MOST)

    @cached_property
    def region_model(self) -> tuple[DataFrame, DataFrame]:
        """Features with cluster, weight and scenario, and the statistics per cluster."""
        names = [c for c in self.features.columns if c != "region_id"]
        if self.features.isEmpty():
            blank = self.features.withColumn("cluster", F.lit(0)).withColumn("forecast_weight", F.lit(0.0)).withColumn("scenario", F.lit("other"))
            return blank, clustering.region_cluster_statistics(blank)
        ranked = self.features.join(self.largest.select("region_id", "change_type", "rank"), "region_id")
        model = clustering.cluster(ranked, names, ["change_type", "rank"], most=2 * regions.MOST_REGIONS)
        labelled = self.features.withColumn("cluster", model.label()).join(polygons.influence_weights(self.features), "region_id")
        labelled = few(labelled, MOST)
        stats = few(clustering.region_cluster_statistics(labelled), MOST)
        meaning = clustering.name_region_clusters(stats.collect())  # a row per cluster
        table = labelled.sparkSession.createDataFrame(list(meaning.items()), "cluster int, scenario string")
        return few(labelled.join(table, "cluster"), MOST), stats

    @cached_property
    def influence(self) -> DataFrame:
        return written(polygons.influence(self.near, self.region_model[0].select("region_id", "forecast_weight"), self.pixels, self.grid), "influence")

    @cached_property
    def scenarios(self) -> DataFrame:
        """Pixels with their scenario: by the region they lie in, else by their cluster."""
        inside = self.region_cells.join(self.region_model[0].select("region_id", "scenario"), "region_id").where("scenario <> 'other'")
        inside = inside.groupBy("row", "col").agg(F.max("scenario").alias("region_scenario"))
        rest = self.pixels.join(inside, ["row", "col"], "left_anti")
        if rest.isEmpty():
            return self.pixels.join(inside, ["row", "col"]).withColumnRenamed("region_scenario", "scenario")
        given = written(clustering.pixel_features(rest), "pixel-features")
        model = clustering.cluster(given, clustering.FEATURES, ["row", "col"])
        labelled = given.withColumn("cluster", model.label())
        meaning = clustering.name_pixel_clusters(clustering.pixel_cluster_statistics(labelled).collect())  # a row per cluster
        table = labelled.sparkSession.createDataFrame(list(meaning.items()), "cluster int, cluster_scenario string")
        named = labelled.join(F.broadcast(table), "cluster").select("row", "col", "cluster_scenario")
        both = self.pixels.join(inside, ["row", "col"], "left").join(named, ["row", "col"], "left")
        scenario = F.coalesce("region_scenario", "cluster_scenario", F.lit("other")).alias("scenario")
        return written(both.select(*self.pixels.columns, scenario), "scenarios")

    @cached_property
    def forecast(self) -> DataFrame:
        """Pixels with scenario and forecast: loss under quotas, recovery under quotas, then greening of steady town."""
        return forecast_of(self.scenarios, self.influence, polygons.footprint(self.near), self.probabilities, self.grid, self.leak)

    @cached_property
    def summary(self) -> DataFrame:
        return statistics.scenario_summary(self.scenarios, self.grid.cell_area)

    @cached_property
    def checks(self) -> DataFrame:
        return quality.report(self.pixels, self.value_statistics, self.transitions, self.largest, self.forecast)

    def tables(self) -> dict[str, DataFrame]:
        base, target = self.base_year, self.target_year
        return {
            "value_statistics": self.value_statistics,
            f"class_areas_{base}": self.class_areas("class_base"),
            f"class_areas_{target}": self.class_areas("class_target"),
            "delta_class_areas": self.class_areas("delta_class"),
            "transition_matrix": self.transitions,
            "largest_changes": regions.with_lonlat(self.largest, self.grid),
            "scenario_summary": self.summary,
            f"ndvi_forecast_{self.forecast_year}": self.forecast.select("row", "col", "scenario", "ndvi_target", "forecast"),
            "checks": self.checks,
        }


def forecast_of(cells: DataFrame, influence: DataFrame, footprint: DataFrame, probabilities: DataFrame, grid: Grid, leak: bool = True) -> DataFrame:
    """``cells`` (pixels with scenario) with forecast. The three changes fall in different scenarios."""
    references = few(allocation.scenario_references(cells), 1)
    scored = allocation.degradation_scores(cells, influence, grid, leak)
    lost, _ = allocation.degrade(scored, footprint, probabilities, grid.width)
    after = allocation.apply_change(cells, lost, "decrease", "ndvi_target", "after_loss")
    able = allocation.recovery_capacity(cells, references)
    gained, _ = allocation.recover(allocation.recovery_scores(able, grid, leak), probabilities, grid.width)
    after = allocation.apply_change(after, gained, "increase", "after_loss", "after_gain")
    green = allocation.greening(after, references, grid, "after_gain")
    return allocation.apply_change(after, green, "increase", "after_gain", "forecast").drop("after_loss", "after_gain")
