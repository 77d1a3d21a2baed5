"""Two-date raster change analytics as Spark DataFrame and SQL operations."""
