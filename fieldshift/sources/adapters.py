"""Two-date rasters out of the tables at hand: a dense one from vectors and a sparse, larger one from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid

WIDTH = 64
#: A cell of the dense raster in this many has no data.
GAP = 97


def vector_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The dense raster's grid, its upper left corner at (500000, 6650000)."""
    last = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
    return Grid(500_000.0, 6_650_000.0, 10.0, 10.0, WIDTH, (last or 0) // 2 + 1)


def vector_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, red_base, nir_base, red_target, nir_target FLOAT): even vectors are the first date, odd ones the change."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    row = F.floor(F.col("vec_id") / 2).cast("int")
    even = vectors.where("vec_id % 2 = 0").select(row.alias("row"), F.col("embedding").alias("a"))
    odd = vectors.where("vec_id % 2 = 1").select(row.alias("row"), F.col("embedding").alias("z"))
    cells = even.join(odd, "row").select("row", F.posexplode(F.arrays_zip("a", "z")).alias("col", "v"))
    first = F.lit(0.4) + F.lit(1.5) * F.col("v.a").cast("double")
    second = first + F.col("v.z").cast("double")

    def band(x, sign):
        return ((F.lit(1.0) + F.lit(sign) * x) / F.lit(2.0)).cast("float")

    return cells.where(F.expr(f"(row * {WIDTH} + col) % {GAP} <> 0")).select(
        "row",
        "col",
        band(first, -1.0).alias("red_base"),
        band(first, 1.0).alias("nir_base"),
        band(second, -1.0).alias("red_target"),
        band(second, 1.0).alias("nir_target"),
    )


def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns from order lines: a cell per order and line number, repeats averaged over whole numbers."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = lines.groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(
        F.count("*").alias("n"),
        F.sum(F.round("l_quantity").cast("long")).alias("q"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("x"),
    )
    whole = F.lit(100.0) * F.col("n")
    nir = ((F.lit(5.0) * F.col("n") + F.lit(18.0) * F.col("q") / F.lit(10.0)) / whole).cast("float")

    def red(part):
        return ((F.lit(10.0) * F.col("n") + F.lit(3.0) * F.col(part)) / whole).cast("float")

    return sums.select(
        "row", "col", red("d").alias("red_base"), nir.alias("nir_base"), red("x").alias("red_target"), nir.alias("nir_target")
    )
