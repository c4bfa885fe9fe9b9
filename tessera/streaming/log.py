"""A durable event log with fan-out.

A batch is persisted first: its events get gap-free ids after those of the batches before, and a ledger
entry makes them visible. Then the subscribers are called in the order of their registration, each with
the batch's events of the types it asked for. A subscriber's error aborts the batch: those after it
are not called, the stream ends, and a restart begins with that batch again. What the ledger holds is
not done twice, so every subscriber that writes a batch under the batch's number gets each event once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators import numbering
from tessera.sources.staging import Files

Handler = Callable[[DataFrame, int], None]


class EventLog:
    """The log under a shared folder; ``order`` tells in which order a batch's events get their ids."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, order: list[Column]):
        self.spark, self.root, self.order = spark, root, order
        self.schema = StructType([*schema.fields]).add("id", "long")
        self.files = Files(spark, root)
        self.subscribers: list[tuple[str, list[str] | None, Handler]] = []

    def subscribe(self, name: str, handle: Handler, types: list[str] | None = None) -> None:
        """Call ``handle`` with the events (of the given types) of each batch and its number."""
        if name in (n for n, _, _ in self.subscribers):
            raise ValueError(f"there is a subscriber {name}")
        self.subscribers.append((name, types, handle))

    def batches(self) -> list[int]:
        """Numbers of the persisted batches in order."""
        return [int(n.removesuffix(".json")) for n in self.files.names("ledger/persisted")]

    def _entry(self, kind: str, number: int) -> str:
        return f"ledger/{kind}/{number:020d}.json"

    def events(self) -> DataFrame:
        """All persisted events with their ids."""
        held = [f"{self.root}/log/batch={n}" for n in self.batches()]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*held) if held else self.spark.createDataFrame([], self.schema)

    def publish(self, batch: DataFrame, number: int) -> None:
        """Persist a batch and fan it out; the stream's ``foreachBatch``."""
        if not self.files.exists(self._entry("persisted", number)):
            earlier = [n for n in self.batches() if n < number]
            last = json.loads(self.files.read(self._entry("persisted", earlier[-1])))["last_id"] if earlier else 0
            path = f"{self.root}/log/batch={number}"
            numbering.numbered(batch, self.order, "id", last).select(*self.schema.names).write.mode("overwrite").parquet(path)
            n = self.spark.read.schema(self.schema).parquet(path).count()
            self.files.publish(self._entry("persisted", number), json.dumps({"last_id": last + n}))
        held = self.spark.read.schema(self.schema).parquet(f"{self.root}/log/batch={number}")
        for name, types, handle in self.subscribers:
            if self.files.exists(self._entry(name, number)):
                continue
            handle(held if types is None else held.filter(F.col("event_type").isin(*types)), number)
            self.files.publish(self._entry(name, number), "{}")

    def start(self, events: DataFrame) -> StreamingQuery:
        """The log over a stream of events, to its present end."""
        return events.writeStream.foreachBatch(self.publish).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()


def to_folder(path: str, make: Callable[[DataFrame], DataFrame] = lambda events: events) -> Handler:
    """A subscriber that writes what it makes of a batch to the batch's own folder, so that a repeated batch replaces itself."""
    def handle(events: DataFrame, number: int) -> None:
        make(events).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle
