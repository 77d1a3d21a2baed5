"""Shared plumbing: scratch tables in the cluster's checkpoint folder and Arrow row mapping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session whose executors are in the driver; on a cluster it is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldshift-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage; its path is in ``df.inputFiles()``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what Python holds at once is bounded.

    With ``most_bytes`` a batch of several rows is halved until it takes no more.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            stack = [batch.slice(at, rows)]
            while stack:
                part = stack.pop()
                if most_bytes is not None and part.num_rows > 1 and part.nbytes > most_bytes:
                    half = part.num_rows // 2
                    stack += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def map_documents(
    docs: DataFrame,
    columns: Sequence[str],
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    rows: int = 256,
    most_bytes: int | None = None,
) -> DataFrame:
    """Apply a batch function to the named columns only; other columns, whatever their names, don't reach Python.

    ``make`` runs once per task and returns the function, so costly state is set up on the executor. A batch has no more
    than ``rows`` rows and, if it has several, than ``most_bytes`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in slices(batches, rows, most_bytes):
            out = apply(batch)
            if out is not None and out.num_rows:
                yield out

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Memory:
    """What was learned lately: a full generation becomes the old one, which is asked before learning anew."""

    def __init__(self, most: int):
        self.now: dict = {}
        self.old: dict = {}
        self.most = most

    def get(self, key):
        found = self.now.get(key)
        return self.old.get(key) if found is None else found

    def put(self, key, value) -> None:
        self.now[key] = value
        self.turn()

    def turn(self) -> None:
        if len(self.now) >= self.most:
            self.now, self.old = {}, self.now
