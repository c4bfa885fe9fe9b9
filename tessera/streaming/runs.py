"""Running a stream over a table to its end: the table is fed as files, a closing row moves the watermark past all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.sources.staging import new_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How far behind all rows the closing row stands.
CLOSING_MS = 1 << 40


def feed(table: DataFrame, time_ms: str, path: str, files: int | None = None) -> None:
    """Write ``table`` as ``files`` files (default: as it is partitioned), and a file of one row whose time lies
    behind all others. The watermark never reaches that row, so it takes part in nothing."""
    (table if files is None else table.repartition(files)).write.mode("append").parquet(path)
    last = table.agg(F.max(time_ms).alias("last")).first().last or 0
    table.limit(1).withColumn(time_ms, F.lit(last + CLOSING_MS)).coalesce(1).write.mode("append").parquet(path)


def through(table: DataFrame, time_ms: str, stream: Callable[[DataFrame], DataFrame], name: str, files: int | None = None, per_trigger: int | None = None, late_ms: int | None = None) -> DataFrame:
    """Rows that ``stream`` (streaming frame with ``at`` and a watermark, to append-mode frame) makes of ``table``.

    ``late_ms`` is how late a row may be; by default as late as the whole table is long, so that files
    may come in any order. The stream runs to its end and is gone when this returns."""
    spark = table.sparkSession
    path = new_path(spark, name)
    if late_ms is None:
        ends = table.agg(F.min(time_ms).alias("a"), F.max(time_ms).alias("b")).first()
        late_ms = (ends.b or 0) - (ends.a or 0) + 1
    feed(table, time_ms, f"{path}/in", files)
    query, schema = started(stream, table.schema, time_ms, path, per_trigger, late_ms, spark)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def started(stream: Callable[[DataFrame], DataFrame], schema, time_ms: str, path: str, per_trigger: int | None, late_ms: int, spark) -> tuple[StreamingQuery, StructType]:
    """The stream, and its schema, from ``path/in`` to ``path/out`` with its state and checkpoint in ``path/checkpoint``, over what is there now."""
    reader = spark.readStream.schema(schema)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.parquet(f"{path}/in").withColumn("at", F.timestamp_millis(time_ms)).withWatermark("at", f"{late_ms} milliseconds")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        made = stream(rows)
        schema = made.schema
        made = made.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        return made.trigger(availableNow=True).start(), schema
    finally:
        spark.conf.set(PROVIDER, before)
