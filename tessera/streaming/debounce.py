"""Debounced file changes (R1, R2), as a batch and as a stream.

A path's changes less than ``gap`` apart are folded in order: a creation makes it Added, a
modification Updated unless Added is pending, a removal Deleted, or nothing where Added was
pending. A quiet path emits what is pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 500


def fold(kinds: Column) -> Column:
    """Outcome of ordered kinds (Created, Modified, Removed); empty text: nothing."""
    def step(pending: Column, kind: Column) -> Column:
        return (
            F.when(kind == "Created", "Added")
            .when(kind == "Modified", F.when(pending == "Added", "Added").otherwise("Updated"))
            .otherwise(F.when(pending == "Added", "").otherwise("Deleted"))
        )

    return F.aggregate(kinds, F.lit(""), step)


def debounced(changes: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """path, kind, at_ms (of the last change) for each burst of ``changes`` (path, kind, at_ms, seq)
    that leaves something.

    Added is pending after a creation and the modifications that follow it, so a burst's outcome
    follows from its last change and from the last creation or removal before that: running windows
    and aggregates, no lists.
    """
    order = Window.partitionBy("path").orderBy("at_ms", "seq")
    fresh = (F.coalesce(F.col("at_ms") - F.lag("at_ms").over(order) >= gap_ms, F.lit(True))).cast("int")
    bursts = changes.withColumn("fresh", fresh).withColumn("burst", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = F.when(F.col("kind") != "Modified", F.struct("burst", "kind"))
    before = F.last(marked, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    added = F.coalesce((before["burst"] == F.col("burst")) & (before["kind"] == "Created"), F.lit(False))
    place = F.struct("at_ms", "seq")
    ends = bursts.withColumn("added", added).groupBy("path", "burst").agg(F.max_by(F.struct("kind", "added"), place).alias("end"), F.max("at_ms").alias("at_ms"))
    last, pending = F.col("end.kind"), F.col("end.added")
    kind = F.when(last == "Created", "Added").when(last == "Modified", F.when(pending, "Added").otherwise("Updated")).otherwise(F.when(pending, "").otherwise("Deleted"))
    return ends.select("path", kind.alias("kind"), "at_ms").filter("kind <> ''")


def debounce_stream(changes: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """The same over a stream (path, kind, at_ms, seq) with a watermark on ``at`` (the timestamp of ``at_ms``).

    Bursts are session windows: their changes wait in the state store until the watermark has passed the burst, and are
    folded in order then, so the outcome does not depend on batches or on the order of arrival; a change whose own
    burst the watermark has passed is dropped by Spark, changes of no path are left out. Sessions that touch
    are one for Spark, bursts a whole gap apart are two: hence a microsecond less."""
    burst = F.session_window("at", f"{gap_ms * 1000 - 1} microseconds")
    made = changes.filter("path IS NOT NULL").groupBy("path", burst).agg(F.array_sort(F.collect_list(F.struct("at_ms", "seq", "kind"))).alias("changes"))
    kind = fold(F.transform("changes", lambda c: c["kind"]))
    return made.select("path", kind.alias("kind"), F.element_at("changes", -1)["at_ms"].alias("at_ms")).filter("kind <> ''")
