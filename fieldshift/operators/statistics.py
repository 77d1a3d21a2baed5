"""Statistics over classes and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.rules import Rule, rule_table
from ..sources.scratch import written
from .ranks import percentiles, percentiles_of_all

HECTARE = 10_000.0


def value_statistics(cells: DataFrame, values: Sequence[str]) -> DataFrame:
    """(metric, pixel_count, mean, minimum, maximum, median, std) per column: exact median, population deviation.

    All columns are unpivoted and aggregated in one pass; medians are found by counts.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values])).alias("m")
    long = written(cells.select(rows).select("m.*").where(raster.finite(F.col("x"))), "values")
    middle = percentiles(long, ["metric"], "x", [0.5], stored=True).select("metric", F.col("p")[0].alias("median"))
    sums = (
        long.groupBy("metric")
        .agg(
            F.count("*").alias("pixel_count"),
            F.avg("x").alias("mean"),
            F.min("x").alias("minimum"),
            F.max("x").alias("maximum"),
            F.stddev_pop("x").alias("std"),
        )
    )
    return sums.join(F.broadcast(middle), "metric").select("metric", "pixel_count", "mean", "minimum", "maximum", "median", "std")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(100.0) * part / F.nullif(whole, F.lit(0))).otherwise(0.0)


def class_areas(cells: DataFrame, column: str, rules: Sequence[Rule], area: Column | float) -> DataFrame:
    """(class_id, label, pixel_count, area_m2, area_ha, percent): a row per rule; percent is of the classified area.

    ``area`` is a cell's area: a number, or a column where it differs by row or cell.
    """
    size = F.lit(float(area)) if isinstance(area, (int, float)) else area
    sums = cells.groupBy(F.col(column).alias("class_id")).agg(F.count("*").alias("n"), F.sum(size).alias("m2"))
    table = rule_table(cells.sparkSession, rules).join(F.broadcast(sums), "class_id", "left")
    n, m2 = F.coalesce("n", F.lit(0)), F.coalesce("m2", F.lit(0.0))
    whole = F.sum(m2).over(Window.partitionBy())  # over one row per rule
    return table.select(
        "class_id",
        "label",
        n.cast("long").alias("pixel_count"),
        m2.alias("area_m2"),
        (m2 / HECTARE).alias("area_ha"),
        _percent(m2, whole).alias("percent"),
    )


def transition_matrix(cells: DataFrame, start: str, end: str, rules: Sequence[Rule], cell_area: float) -> DataFrame:
    """A row per pair of rules: counts, areas, and shares of all cells that have both classes."""
    spark = cells.sparkSession
    ids = [r.class_id for r in rules]
    counts = (
        cells.where(F.col(start).isin(ids) & F.col(end).isin(ids))
        .groupBy(F.col(start).alias("from_class"), F.col(end).alias("to_class"))
        .agg(F.count("*").alias("n"))
    )
    a = rule_table(spark, rules).toDF("from_class", "from_label")
    b = rule_table(spark, rules).toDF("to_class", "to_label")
    full = a.crossJoin(b).join(F.broadcast(counts), ["from_class", "to_class"], "left")  # rules by rules
    n = F.coalesce("n", F.lit(0)).cast("long")
    whole = F.sum(n).over(Window.partitionBy())
    return full.select(
        "from_class",
        "from_label",
        "to_class",
        "to_label",
        F.concat_ws(" -> ", F.col("from_class").cast("string"), F.col("to_class").cast("string")).alias("transition"),
        n.alias("pixel_count"),
        (n * cell_area).alias("area_m2"),
        (n * cell_area / HECTARE).alias("area_ha"),
        _percent(n * cell_area, whole * cell_area).alias("percent"),
        _percent(n, whole).alias("pixel_percent"),
    )


def transition_probabilities(matrix: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(from_class, to_class, probability): rows of a count table over their sums; a class without cells stays as it is.

    Repeated pairs add up, classes outside the rules are ignored, absent pairs count 0.
    """
    missing = {"from_class", "to_class", "pixel_count"} - set(matrix.columns)
    if missing:
        raise ValueError(f"count table lacks {sorted(missing)}")
    spark, ids = matrix.sparkSession, [r.class_id for r in rules]
    counts = matrix.groupBy("from_class", "to_class").agg(F.sum("pixel_count").alias("n"))
    a, b = rule_table(spark, rules).select(F.col("class_id").alias("from_class")), rule_table(spark, rules).select(F.col("class_id").alias("to_class"))
    full = a.crossJoin(b).join(F.broadcast(counts.where(F.col("from_class").isin(ids))), ["from_class", "to_class"], "left")
    n = F.coalesce("n", F.lit(0))
    whole = F.sum(n).over(Window.partitionBy("from_class"))
    same = F.when(F.col("from_class") == F.col("to_class"), 1.0).otherwise(0.0)
    return full.select("from_class", "to_class", F.when(whole == 0, same).otherwise(n / F.nullif(whole, F.lit(0))).alias("probability"))


def display_range(cells: DataFrame, values: Sequence[str], low: float, high: float, around_zero: bool = False) -> DataFrame:
    """(vmin, vmax): interpolated percentiles over the columns' values together, widened where they meet.

    ``around_zero`` makes room for the sign that is missing.
    """
    x = F.explode(F.array(*[F.col(v).cast("double") for v in values])).alias("x")
    ends = percentiles_of_all(cells.select(x), F.col("x"), [low, high])
    table = ends.select(F.col("p")[0].alias("vmin"), F.col("p")[1].alias("vmax"))
    if around_zero:
        table = table.withColumn(
            "vmin", F.when(F.col("vmin") >= 0, -F.greatest(F.col("vmax") * 0.05, F.lit(0.01))).otherwise(F.col("vmin"))
        ).withColumn("vmax", F.when(F.col("vmax") <= 0, F.greatest(F.abs("vmin") * 0.05, F.lit(0.01))).otherwise(F.col("vmax")))
    margin = F.when(F.col("vmax") > F.col("vmin"), 0.0).otherwise(F.greatest(F.abs("vmin") * 0.05, F.lit(0.01)))
    return table.select((F.col("vmin") - margin).alias("vmin"), (F.col("vmax") + margin).alias("vmax"))


def scenario_summary(cells: DataFrame, cell_area: float) -> DataFrame:
    """(scenario, pixel_count, area_ha) for the run's log."""
    return cells.groupBy("scenario").agg(F.count("*").alias("pixel_count"), (F.count("*") * cell_area / HECTARE).alias("area_ha"))
