"""Connected components by alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import discard, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star round, then one small-star round, over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        both.join(lowest, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    ``edges`` has two integer columns, in either direction, with repeats, loops or nulls (loops and nulls are
    dropped). No node's neighbours are gathered in one row: rounds are grouped minima and equi joins whose skewed
    keys adaptive execution can split, and each round is written to the shared folder.
    """
    a, b = edges.columns[:2]
    plain = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    now = materialize(plain, "edges")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, before = state, now
        now = materialize(_stars(before), "edges")
        discard(before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
