"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one JVM (tests) a local folder is set; on a
    cluster that is an error, since executors could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held.rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives lost executors; the write is Spark's own committed one. The
    table's path is added to ``paths``, for :func:`delete` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Setting by which Spark removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write Parquet; the shuffle files behind it go when it is done, since it is reread from ``path``."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables, through Spark's own file systems."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


_LEFT: dict[str, Callable[[], None]] = {}


def entering(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called where a task starts in a Python worker: what other operators' tasks have left in the
    worker is dropped (each names with ``clear`` how), and free memory goes back to the system."""
    for name in [n for n in _LEFT if n != owner]:
        _LEFT.pop(name)()
    if clear is not None:
        _LEFT[owner] = clear
    trim()


def trim() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of fewer rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
