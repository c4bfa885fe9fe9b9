"""The job worker as a stateful stream.

Each workspace has one consumer and a queue in the state store. Jobs that arrive within one tick are
taken when the watermark has passed its end, highest priority first, then least id; a job that
fails counts a retry and, while retries are left, is queued again, where it is the first to be taken once
more. Unknown types and payloads without workspace or path fail in the same way. A job
that succeeds is enriched only where its document was really indexed, not where it was unchanged.
The running number of a workspace's attempts survives restarts with the state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

JOB_TYPE = "index_document"
#: What a worker makes of a job and the number of its earlier failures.
INDEXED, UNCHANGED, FAILED = "indexed", "unchanged", "failed"
ATTEMPTS = "place long, id long, attempt int, status string, enriched boolean, error string"


def refusal(job_id: int, job_type: str | None, payload: str | None) -> str | None:
    """Why a job cannot be run at all."""
    if job_type != JOB_TYPE:
        return f"unrecognized job type '{job_type}'"
    try:
        held = json.loads(payload or "")
    except ValueError:
        held = None
    held = held if isinstance(held, dict) else {}
    workspace = held.get("workspace_id")
    if not isinstance(workspace, int) or isinstance(workspace, bool):
        return f"job {job_id}: payload missing 'workspace_id'"
    if not isinstance(held.get("relative_path"), str):
        return f"job {job_id}: payload missing 'relative_path'"
    return None


def attempts(job_id: int, job_type: str | None, payload: str | None, max_retries: int, run: Callable[[str, int], tuple[str, str | None]]) -> Iterator[tuple[int, str, bool, str | None]]:
    """(attempt, status, enriched, error) of one job until it succeeds or its retries are used up."""
    why = refusal(job_id, job_type, payload)
    for n in range(1, max_retries + 2):
        outcome, error = (FAILED, why) if why else run(payload, n - 1)
        if outcome != FAILED:
            yield n, "succeeded", outcome == INDEXED, None
            return
        yield n, "queued" if n <= max_retries else "failed", False, error


def work(jobs: DataFrame, run: Callable[[str, int], tuple[str, str | None]], tick_ms: int) -> DataFrame:
    """Attempts of a stream of jobs (workspace_id, id, job_type, payload, priority, max_retries, at_ms, and the
    watermarked ``at``) in the order of their workspace's consumer. ``run`` takes a payload and the
    number of failures so far, and returns an outcome and an error. Jobs of no workspace are left out."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Queue(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.queue = handle.getListState("queue", "tick array<long>, priority array<int>, id array<long>, job_type array<string>, payload array<string>, max_retries array<int>")
            self.place = handle.getValueState("place", "n long")

        def handleInputRows(self, key, rows, timerValues):
            columns = ("at_ms", "priority", "id", "job_type", "payload", "max_retries")
            arrived = [(int(at) // tick_ms, int(p), int(i), t, x, int(r)) for frame in rows for at, p, i, t, x, r in zip(*(frame[c] for c in columns), strict=True)]
            self.queue.appendValue(tuple(list(c) for c in zip(*arrived, strict=True)))
            self.handle.registerTimer((min(a[0] for a in arrived) + 1) * tick_ms)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            over = timerValues.getCurrentWatermarkInMs() // tick_ms  # ticks before it are over
            queued = sorted((q for held in self.queue.get() for q in zip(*held, strict=True)), key=lambda q: (q[0], -q[1], q[2]))
            ready = [q for q in queued if q[0] < over]
            later = queued[len(ready) :]
            if later:
                self.handle.registerTimer((later[0][0] + 1) * tick_ms)
            if not ready:  # taken with an earlier timer
                return
            self.queue.put([tuple(list(c) for c in zip(*later, strict=True))]) if later else self.queue.clear()
            place = self.place.get()[0] if self.place.exists() else 0
            made = []
            for _, _, job_id, job_type, payload, max_retries in ready:
                for attempt in attempts(job_id, job_type, payload, max_retries, run):
                    place += 1
                    made.append((key[0], place, job_id, *attempt))
            self.place.update((place,))
            yield pd.DataFrame(made, columns=["workspace_id", "place", "id", "attempt", "status", "enriched", "error"])

        def close(self) -> None:
            pass

    kind = jobs.schema["workspace_id"].dataType.simpleString()
    return jobs.filter("workspace_id IS NOT NULL").groupBy("workspace_id").transformWithStateInPandas(Queue(), f"workspace_id {kind}, {ATTEMPTS}", "Append", "EventTime")
