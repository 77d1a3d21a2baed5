"""Exact order statistics by counting in ranges, so that no task holds or sorts all values of a group.

A group's span is cut into pieces; counts by piece, a small table, tell in which piece a rank lies, and only that piece's
values are told apart. Every pass is a scan with partial aggregation. Groups are few (columns, classes, regions), so
what is known of them is broadcast. Where a count shows that no group has more than ``AT_ONCE`` values, which one task
can hold, one aggregate gives the same percentiles in a single pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

PIECES = 4096
AT_ONCE = 1 << 20


def ranked(values: DataFrame, by: Sequence[str], x: str, wanted: DataFrame, pieces: int = PIECES) -> DataFrame:
    """(by..., rank, x): the values at the ranks, 0 for the smallest, that ``wanted`` (by..., rank) asks for.

    ``x`` has finite numbers only. Ranks that a group doesn't have give no row.
    """
    keys = [*by]
    ends = values.groupBy(*keys).agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    share = (F.col(x).cast("double") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    piece = F.coalesce(F.least(F.floor(share * F.lit(pieces)), F.lit(pieces - 1)), F.lit(0)).cast("int")
    placed = values.select(*keys, x).join(F.broadcast(ends), keys).select(*keys, x, piece.alias("_piece"))

    counts = placed.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece"))
    hit = (
        counts.withColumn("_upto", upto)
        .join(F.broadcast(wanted.select(*keys, "rank").distinct()), keys)
        .where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
        .select(*keys, "_piece", "rank", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_local"))
    )
    inside = placed.join(F.broadcast(hit.select(*keys, "_piece").distinct()), [*keys, "_piece"], "left_semi")
    inside = inside.groupBy(*keys, "_piece", x).agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_piece").orderBy(x))
    return (
        inside.withColumn("_upto", upto)
        .join(F.broadcast(hit), [*keys, "_piece"])
        .where((F.col("_local") < F.col("_upto")) & (F.col("_local") >= F.col("_upto") - F.col("_m")))
        .select(*keys, "rank", x)
    )


def percentiles(values: DataFrame, by: Sequence[str], x: str, shares: Sequence[float], stored: bool = False) -> DataFrame:
    """(by..., p): an array with the interpolated percentile of each share, over the values that are finite numbers.

    Values are written once, as several passes read them, unless ``stored`` says that they come from such a table.
    """
    keys = [*by]
    value = F.col(x).cast("double")
    clean = values.select(*keys, value.alias("_x")).where(~F.isnan("_x") & (F.abs("_x") < float("inf")))
    clean = clean if stored else written(clean, "values")
    sizes = clean.groupBy(*keys).agg(F.count("*").alias("_size"))
    if (sizes.agg(F.max("_size")).first()[0] or 0) <= AT_ONCE:
        return clean.groupBy(*keys).agg(F.percentile("_x", F.array(*[F.lit(float(s)) for s in shares])).alias("p"))
    places = [F.lit(float(s)) * (F.col("_size") - 1) for s in shares]
    ranks = F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)])
    found = ranked(clean, keys, "_x", sizes.select(*keys, F.explode(ranks).alias("rank")))
    table = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_x"))).alias("_at"))  # two entries a share at most

    def between(place: Column) -> Column:
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    return table.join(F.broadcast(sizes), keys).select(*keys, F.array(*map(between, places)).alias("p"))


def percentiles_of_all(values: DataFrame, x: Column, shares: Sequence[float]) -> DataFrame:
    """One row (p) over all values; none where there is no finite one."""
    return percentiles(values.select(F.lit(0).alias("_all"), x.alias("_v")), ["_all"], "_v", shares).select("p")


def medians(values: DataFrame, by: Sequence[str], columns: Sequence[str], stored: bool = False) -> DataFrame:
    """(by..., columns...): each column's median, by one count over all of them; null where a group has no value."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("m")
    long = values.select(*by, parts).select(*by, "m.*")
    found = percentiles(long, [*by, "_name"], "_v", [0.5], stored)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == c, F.col("p")[0])).alias(c) for c in columns])
