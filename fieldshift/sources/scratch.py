"""Cutting lineage: tables written to the cluster's shared folder, and tables of a few rows held by the plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back; removed when the driver's JVM ends.

    Where that is unset, a temporary folder serves a session whose executors are in the driver; on a cluster it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldshift-raster-"))
        root = sc.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> DataFrame:
    """The rows of a table that can't have more than ``most``, as literals of the plan; more rows raise."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)
