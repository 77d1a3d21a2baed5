"""Where the scenario changes cells: ranked under quotas from transition probabilities, and by how much.

A quota per (from, to) class pair takes its cells in the order of a score. Taking quotas one after the other is the same
as ranking a class's cells once and cutting the ranks at the quotas' running sums, which is a join on class and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.grid import Grid
from ..functions.rules import INDEX_RULES, midpoint
from ..sources.scratch import few, written
from .focal import window_means
from .ranks import percentiles, ranked

# Fixed values.
SCORE = {"influence": 0.45, "capacity": 0.25, "loss_around": 0.20, "variability": 0.10}
EXHAUSTED_CHANGE, EXHAUSTED_INDEX = 0.35, 0.18
GREENING = (0.03, 0.08)
PAIRS = len(INDEX_RULES) ** 2
SCENARIOS = ("new_development", "stable_urban", "stable_green", "degradation", "other")


def scenario_references(cells: DataFrame) -> DataFrame:
    """One row: median second-date index of stable_urban and of stable_green (of all, where one has no cell), and the
    ceiling halfway between them."""
    known = F.when(F.col("scenario").isin("stable_urban", "stable_green"), F.col("scenario"))
    groups = F.explode(F.array_compact(F.array(F.lit("all"), known))).alias("group")
    found = percentiles(cells.select(groups, "ndvi_target"), ["group"], "ndvi_target", [0.5])
    middle = lambda name: F.max(F.when(F.col("group") == name, F.col("p")[0]))
    whole = F.coalesce(middle("all"), F.lit(0.0))
    table = found.agg(F.coalesce(middle("stable_urban"), whole).alias("urban"), F.coalesce(middle("stable_green"), whole).alias("green"))
    return table.withColumn("ceiling", (F.col("urban") + F.col("green")) / 2)


def loss(delta: Column) -> Column:
    return F.abs(F.least(delta.cast("double"), F.lit(0.0)))


def recovery_capacity(cells: DataFrame, references: DataFrame) -> DataFrame:
    """Adds capacity: how far a cell may rise, by what it lost and by the lower of its first index and the ceiling."""
    target = F.least(F.col("ndvi_base").cast("double"), F.col("ceiling"))
    room = F.greatest(target - F.col("ndvi_target").cast("double"), F.lit(0.0))
    return cells.crossJoin(F.broadcast(references.select("ceiling"))).withColumn("capacity", F.least(room, loss(F.col("delta")))).drop("ceiling")


def has_gaps(cells: DataFrame, grid: Grid) -> bool:
    return cells.count() < grid.width * grid.height


def _largest(cells: DataFrame, **values: Column) -> DataFrame:
    return cells.agg(*[F.coalesce(F.max(v), F.lit(0.0)).alias(f"max_{n}") for n, v in values.items()])


def degradation_scores(cells: DataFrame, influence: DataFrame, grid: Grid, leak: bool = True) -> DataFrame:
    """Cells with influence, base_loss and score.

    With ``leak`` the grid's empty cells take part in the normalisation of the change as their nodata value, so that
    where there is any the capacity term is about 1 everywhere; without it only valid cells do.
    """
    x, valid = F.col("ndvi_target").cast("double"), F.lit(True)
    around = window_means(cells, grid, {"loss_around": loss(F.col("delta")), "m": x, "s": x * x}, valid)
    around = around.select("row", "col", "loss_around", F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0))).alias("variability"))
    tops = around.agg(F.max("loss_around").alias("max_around"), F.max("variability").alias("max_variability"))
    size = F.abs(F.col("delta").cast("double"))
    both = cells.join(influence, ["row", "col"]).join(around, ["row", "col"])
    tops = tops.crossJoin(_largest(both, influence=F.col("influence"), size=size))
    if leak and has_gaps(cells, grid):
        tops = tops.withColumn("max_size", F.greatest("max_size", F.lit(abs(raster.NODATA))))
    scored = both.crossJoin(F.broadcast(tops))
    near = raster.share_of_max(F.col("influence"), F.col("max_influence"))
    score = (
        F.lit(SCORE["influence"]) * near
        + F.lit(SCORE["capacity"]) * (F.lit(1.0) - raster.share_of_max(size, F.col("max_size")))
        + F.lit(SCORE["loss_around"]) * raster.share_of_max(F.col("loss_around"), F.col("max_around"))
        + F.lit(SCORE["variability"]) * raster.share_of_max(F.col("variability"), F.col("max_variability"))
    )
    return scored.select(*cells.columns, "influence", (F.col("loss_around") * near).alias("base_loss"), score.alias("score"))


def recovery_scores(cells: DataFrame, grid: Grid, leak: bool = True) -> DataFrame:
    """Cells with capacity get a score from it and from their loss."""
    tops = _largest(cells, capacity=F.col("capacity"), loss=loss(F.col("delta")))
    if leak and has_gaps(cells, grid):
        tops = tops.withColumn("max_loss", F.greatest("max_loss", F.lit(abs(raster.NODATA))))
    score = raster.share_of_max(F.col("capacity"), F.col("max_capacity")) + raster.share_of_max(loss(F.col("delta")), F.col("max_loss"))
    return cells.crossJoin(F.broadcast(tops)).withColumn("score", score).drop("max_capacity", "max_loss")


def quotas(eligible: DataFrame, probabilities: DataFrame, rising: bool) -> DataFrame:
    """(from_class, to_class, probability, requested, low, high): a class's cells times the probability, halves to even;
    ranks over low up to high are the quota's."""
    counts = eligible.groupBy(F.col("class_target").alias("from_class")).agg(F.count("*").alias("n"))
    pairs = probabilities.where("to_class > from_class" if rising else "to_class < from_class").join(counts, "from_class")
    asked = pairs.withColumn("requested", F.rint(F.col("n") * F.col("probability")).cast("long")).where("requested > 0")
    high = F.sum("requested").over(Window.partitionBy("from_class").orderBy("to_class"))  # at most four rows a class
    return asked.withColumn("high", high).select("from_class", "to_class", "probability", "requested", (F.col("high") - F.col("requested")).alias("low"), "high")


def select_by_quota(candidates: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """Candidates with to_class: each class ranked by score, ties by the later cell first, and cut at the quotas of
    :func:`quotas`, which has a row per pair of classes at most.

    Only the score and, among cells that have it, the place at which a quota ends are looked for, by counts in ranges.
    Every cell is then compared with its class's few cuts, so no class is sorted, however its scores are spread or tied.
    """
    same = F.col("class_target") == F.col("from_class")
    placed = candidates.withColumn("_place", F.col("row").cast("long") * F.lit(width) + F.col("col"))
    sizes = placed.groupBy("class_target").agg(F.count("*").alias("_n"))
    ends = few(table.join(sizes, same).where("high < _n").select("class_target", "high", (F.col("_n") - F.col("high")).alias("rank")), PAIRS)
    scores = ranked(placed.select("class_target", "score"), ["class_target"], "score", ends)
    edges = few(ends.join(scores.withColumnRenamed("score", "edge"), ["class_target", "rank"]).select("class_target", "high", "edge"), PAIRS)

    near = placed.select("class_target", "score", "_place").join(F.broadcast(edges), "class_target")
    over = near.groupBy("class_target", "high", "edge").agg(F.count_if(F.col("score") > F.col("edge")).alias("_over"), F.count_if(F.col("score") == F.col("edge")).alias("_tied"))
    # of the tied cells those with the largest places fill the quota
    last = few(over.select("class_target", "high", (F.col("_tied") - (F.col("high") - F.col("_over"))).alias("rank")), PAIRS)
    tied = near.where("score = edge").select("class_target", "high", "_place")
    places = ranked(tied, ["class_target", "high"], "_place", last).select("class_target", "high", F.col("_place").alias("least"))
    cuts = few(edges.join(places, ["class_target", "high"]), PAIRS)

    def named(prefix: str) -> DataFrame:
        return cuts.select(F.col("class_target").alias(f"{prefix}_class"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("high", "edge", "least")])

    full = (
        table.select("from_class", "to_class", "low", "high")
        .join(named("u"), (F.col("from_class") == F.col("u_class")) & (F.col("high") == F.col("u_high")), "left")
        .join(named("d"), (F.col("from_class") == F.col("d_class")) & (F.col("low") == F.col("d_high")), "left")
    )

    def within(prefix: str) -> Column:
        edge = F.col(f"{prefix}_edge")
        return (F.col("score") > edge) | ((F.col("score") == edge) & (F.col("_place") >= F.col(f"{prefix}_least")))

    # a quota without an upper cut takes all that is left; one that starts where the class ends takes nothing
    starts = F.when(F.col("low") == 0, F.lit(True)).otherwise(F.coalesce(~within("d"), F.lit(False)))
    chosen = placed.join(F.broadcast(full), same).where(F.coalesce(within("u"), F.lit(True)) & starts)
    return chosen.select(*candidates.columns, "to_class")


def _moves_to(falling: bool) -> Column:
    pairs = [F.lit(v) for r in INDEX_RULES for v in (r.class_id, midpoint(r, falling))]
    return F.create_map(*pairs)[F.col("to_class")]


def degrade(scored: DataFrame, footprint: DataFrame, probabilities: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(row, col, to_class, applied) of cells that lose, and the quota table.

    Eligible are degradation cells in the footprint under influence; exhausted ones count for quotas but aren't taken.
    """
    eligible = scored.where("scenario = 'degradation' and influence > 0").join(footprint, ["row", "col"], "left_semi")
    eligible = written(eligible, "losing")
    table = few(quotas(eligible, probabilities, rising=False), PAIRS)
    tired = (F.abs(F.col("delta")) > raster.single(EXHAUSTED_CHANGE)) & (F.col("ndvi_target") < raster.single(EXHAUSTED_INDEX))
    taken = select_by_quota(eligible.where(~tired), table, width)
    needed = F.greatest(F.col("ndvi_target").cast("double") - _moves_to(True), F.lit(0.0))
    return taken.select("row", "col", "to_class", F.greatest("base_loss", needed).alias("applied")), table


def recover(scored: DataFrame, probabilities: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(row, col, to_class, applied) of newly built cells that gain within their capacity, and the quota table."""
    eligible = written(scored.where("scenario = 'new_development' and capacity > 0"), "gaining")
    table = few(quotas(eligible, probabilities, rising=True), PAIRS)
    taken = select_by_quota(eligible, table, width)
    needed = F.greatest(_moves_to(False) - F.col("ndvi_target").cast("double"), F.lit(0.0))
    return taken.select("row", "col", "to_class", F.least("capacity", F.greatest(needed, F.lit(raster.FLOAT_STEP))).alias("applied")), table


def greening(cells: DataFrame, references: DataFrame, grid: Grid, current: str = "ndvi_target") -> DataFrame:
    """(row, col, applied): stable urban cells at or below the urban median, with green around, gain by its density,
    up to the ceiling. ``current`` is the index after the other changes."""
    known = cells.crossJoin(F.broadcast(references))
    green = (F.col("scenario") == "stable_green") | (F.col("ndvi_target").cast("double") >= F.col("green"))
    density = window_means(known, grid, {"density": green.cast("double")}, F.lit(True))
    top = density.agg(F.max("density").alias("max_density"))
    low, high = GREENING
    share = raster.share_of_max(F.col("density"), F.col("max_density"))
    room = F.greatest(F.col("ceiling") - F.col(current).cast("double"), F.lit(0.0))
    gain = F.least(F.lit(low) + F.lit(high - low) * share, room)
    return (
        known.where(F.col("scenario") == "stable_urban")
        .where(F.col(current).cast("double") <= F.col("urban"))
        .join(density, ["row", "col"])
        .crossJoin(F.broadcast(top))
        .where("density > 0")
        .select("row", "col", gain.alias("applied"))
        .where("applied > 0")
    )


def apply_change(cells: DataFrame, applied: DataFrame, direction: str, current: str = "ndvi_target", out: str = "forecast") -> DataFrame:
    """``cells`` with ``out``: the current index less or plus what applies, all within [-1, 1]."""
    if direction not in ("decrease", "increase"):
        raise ValueError(f"unknown direction {direction!r}")
    step = F.coalesce("applied", F.lit(0.0)) * (-1.0 if direction == "decrease" else 1.0)
    moved = raster.clamp((F.col(current).cast("double") + step).cast("float"))
    return cells.join(applied.select("row", "col", "applied"), ["row", "col"], "left").withColumn(out, moved).drop("applied")


def changed_cells(cells: DataFrame, before: str = "ndvi_target", after: str = "forecast") -> DataFrame:
    return cells.agg(F.count(F.when(raster.differs(F.col(before), F.col(after)), 1)).alias("changed"))
