"""Class counts kept up to date as tiles of a raster arrive as Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pixels

BANDS = "row int, col int, red_base float, nir_base float, red_target float, nir_target float"


def arriving_bands(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(BANDS).parquet(path)


def class_counts(bands: DataFrame) -> DataFrame:
    """(class_base, class_target, pixel_count): state is one row per pair of classes, whatever arrives."""
    classed = pixels.classified(pixels.valid_pixels(pixels.index_from_bands(bands)))
    return classed.groupBy("class_base", "class_target").agg(F.count("*").alias("pixel_count"))


def start(spark: SparkSession, path: str, name: str, checkpoint: str) -> StreamingQuery:
    """Run until stopped; the counts are in the table ``name``."""
    counts = class_counts(arriving_bands(spark, path))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
