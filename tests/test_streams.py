"""Stateful streams and the event log: order of arrival, restarts, errors of subscribers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import numbering
from tessera.sources.staging import Files
from tessera.streaming import debounce, log, runs, worker

JOBS = "workspace_id long, id long, job_type string, payload string, priority int, max_retries int, at_ms long"


def job(ws, i, at, priority=0, path="a", kind="index_document", retries=3):
    return (ws, i, kind, json.dumps({"workspace_id": ws} | ({"relative_path": path} if path else {})), priority, retries, at)


def runner():
    """A function of its own, so that workers need not import this module."""
    def run(payload, failures):
        path = json.loads(payload)["relative_path"]
        if path.startswith("busy") and failures < int(path[4:]):
            return "failed", "busy"
        return ("unchanged" if path == "same" else "indexed"), None

    return run


run = runner()


def fold(rows, tick=1000):
    """Attempts in plain Python."""
    out, place = [], {}
    for ws, i, kind, payload, _, retries, at in sorted(rows, key=lambda r: (r[0], r[6] // tick, -r[4], r[1])):
        for attempt, status, enriched, error in worker.attempts(i, kind, payload, retries, run):
            place[ws] = place.get(ws, 0) + 1
            out.append((ws, place[ws], i, attempt, status, enriched, error))
    return sorted(out)


def test_worker_rules():
    assert list(worker.attempts(1, "index_document", '{"workspace_id": 1, "relative_path": "busy2"}', 3, run)) == [(1, "queued", False, "busy"), (2, "queued", False, "busy"), (3, "succeeded", True, None)]
    assert [a[1] for a in worker.attempts(1, "index_document", '{"workspace_id": 1, "relative_path": "busy9"}', 3, run)] == ["queued"] * 3 + ["failed"]
    assert list(worker.attempts(1, "index_document", '{"workspace_id": 1, "relative_path": "same"}', 3, run)) == [(1, "succeeded", False, None)]
    for kind, payload in (("other", '{"workspace_id": 1, "relative_path": "a"}'), ("index_document", None), ("index_document", "[1]"), ("index_document", "{"), ("index_document", '{"workspace_id": true, "relative_path": "a"}'), ("index_document", '{"workspace_id": 1}')):
        assert [a[1] for a in worker.attempts(7, kind, payload, 0, run)] == ["failed"]


def test_worker_order_and_restart(spark, tmp_path):
    """Two runs over one checkpoint: the second takes up queue and numbers where the first left them, and repeats nothing."""
    rng = random.Random(4)
    first = [job(rng.randint(1, 4), i, rng.randint(0, 9_000), rng.randint(0, 2), rng.choice(["a", "same", "busy1", "busy5", None]), rng.choice(["index_document", "index_document", "odd"])) for i in range(120)]
    second = [job(rng.randint(1, 4), 1000 + i, rng.randint(10_000, 19_000), rng.randint(0, 2), rng.choice(["a", "busy2"])) for i in range(60)]
    path = str(tmp_path)
    stream = lambda rows: worker.work(rows, run, 1000)

    def go():
        query, schema = runs.started(stream, spark.createDataFrame([], JOBS).schema, "at_ms", path, 1, 0, spark)
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{path}/out").collect())

    frame = lambda rows: spark.createDataFrame(rows, JOBS).coalesce(1)
    frame(first).write.parquet(f"{path}/in")
    frame([job(9, 0, 12_000)]).write.mode("append").parquet(f"{path}/in")  # ends the first ticks, and stays queued itself
    got = go()
    assert got == fold(first)
    frame(second + [job(1, 5000, 100)]).write.mode("append").parquet(f"{path}/in")  # with one that is too late
    frame([job(9, 1, 50_000)]).write.mode("append").parquet(f"{path}/in")
    got = go()
    left = [r for r in got if r[2] < 5000]
    want = fold(first + [r for r in second if r[6] > 12_000] + [job(9, 0, 12_000)])
    assert left == want and not any(r[2] in (1, 5000) and r[0] in (1, 9) and r[2] == 5000 for r in got)


def test_debounce_does_not_depend_on_batches_or_arrival(spark):
    rng = random.Random(8)
    rows = [(f"p{rng.randint(0, 5)}", rng.choice(["Created", "Modified", "Removed"]), rng.randint(0, 20_000), i) for i in range(300)]
    table = spark.createDataFrame(rows, "path string, kind string, at_ms long, seq long")
    want = sorted(tuple(r) for r in debounce.debounced(table, 700).collect())
    for files, per_trigger in ((1, None), (7, 1)):
        made = runs.through(table, "at_ms", lambda s: debounce.debounce_stream(s, 700), "test-debounce", files=files, per_trigger=per_trigger)
        assert sorted(tuple(r) for r in made.collect()) == want
    empty = runs.through(table.limit(0), "at_ms", lambda s: debounce.debounce_stream(s, 700), "test-empty")
    assert empty.columns == ["path", "kind", "at_ms"] and empty.count() == 0


def test_log_gives_each_event_once_after_an_error(spark, tmp_path):
    root = str(tmp_path)
    events = spark.createDataFrame([(i, "FileAdded" if i % 3 else "FileDeleted", f"x{i}") for i in range(40)], "n long, event_type string, payload string")
    events.repartition(4).write.parquet(f"{root}/in")
    calls, broken = [], [True]

    def own():
        held = log.EventLog(spark, root, events.schema, [F.col("n")])

        def second(batch, number):
            calls.append(("second", number))
            if number == 2 and broken[0]:
                raise RuntimeError("subscriber is out of order")
            batch.write.mode("overwrite").parquet(f"{root}/second/batch={number}")

        held.subscribe("first", lambda b, n: (calls.append(("first", n)), log.to_folder(f"{root}/first")(b, n)), ["FileDeleted"])
        held.subscribe("second", second)
        held.subscribe("third", lambda b, n: calls.append(("third", n)))
        with pytest.raises(ValueError):
            held.subscribe("third", second)
        return held

    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    held = own()
    assert held.events().count() == 0
    query = held.start(stream())
    with pytest.raises(Exception, match="out of order"):
        query.awaitTermination()
    assert calls[-2:] == [("first", 2), ("second", 2)] and held.batches() == [0, 1, 2]  # persisted first; the third is not called
    before = {r.n: r.id for r in held.events().collect()}
    broken[0] = False
    held = own()
    held.start(stream()).awaitTermination()
    assert [c for c in calls if c[0] == "third"] == [("third", n) for n in range(4)]
    assert [c for c in calls if c[0] == "first"] == [("first", n) for n in range(4)]  # not repeated for batch 2
    after = {r.n: r.id for r in held.events().collect()}
    assert sorted(after.values()) == list(range(1, 41)) and all(after[n] == i for n, i in before.items())
    assert sorted(r.n for r in spark.read.parquet(f"{root}/second").collect()) == list(range(40))
    assert sorted(r.n for r in spark.read.parquet(f"{root}/first").collect()) == list(range(0, 40, 3))


def test_numbers_have_no_gap_and_no_wide_task(spark):
    rows = [(i % 7 if i % 5 else None, i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g long, v long, i long")
    got = numbering.numbered(df, [F.col("v").desc(), F.col("i")], start=10).orderBy("number").collect()
    assert [r.number for r in got] == list(range(11, 1011)) and [(-r.v, r.i) for r in got] == sorted((-v, i) for _, v, i in rows)
    ranked = numbering.ranked_within(df, ["g"], [F.col("i")], size="n")
    plan = ranked._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    for g in {r[0] for r in rows}:
        own = sorted((r.i, r["rank"], r.n) for r in ranked.collect() if r.g == g)
        assert [r[1] for r in own] == list(range(1, len(own) + 1)) and {r[2] for r in own} == {len(own)}
    assert numbering.numbered(df.limit(0), [F.col("i")]).count() == 0


def test_published_files_appear_once(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert files.publish("a/b.json", "ä1") and not files.publish("a/b.json", "2")
    assert files.read("a/b.json") == "ä1" and files.names("a") == ["b.json"] and files.names("none") == []


def test_worker_sets_one_timer_a_workspace_and_batch(spark, tmp_path):
    """Not one for each tick that has jobs."""
    spark.createDataFrame([job(1, i, 1000 * (i + 1)) for i in range(200)] + [job(2, 500, 1 << 40)], JOBS).coalesce(1).write.parquet(f"{tmp_path}/in")
    query, schema = runs.started(lambda rows: worker.work(rows, run, 1000), spark.createDataFrame([], JOBS).schema, "at_ms", str(tmp_path), 1, 0, spark)
    query.awaitTermination(120)
    assert spark.read.schema(schema).parquet(f"{tmp_path}/out").count() == 200
    timers = [m["numRegisteredTimers"] for p in query.recentProgress for m in [p["stateOperators"][0]["customMetrics"]]]
    assert 2 <= sum(timers) <= 4


def test_bursts_of_a_stream_are_windows_and_end_a_whole_gap_apart(spark):
    rows = [("a", "Created", 0, 1), ("a", "Modified", 99, 2), ("a", "Removed", 199, 3), ("b", "Created", 0, 4), ("b", "Removed", 99, 5)]
    table = spark.createDataFrame(rows, "path string, kind string, at_ms long, seq long")
    stream = lambda s: debounce.debounce_stream(s, 100)
    assert sorted(tuple(r) for r in runs.through(table, "at_ms", stream, "test-gap").collect()) == [("a", "Added", 99), ("a", "Deleted", 199)]
    plan = stream(table.withColumn("at", F.timestamp_millis("at_ms")))._jdf.queryExecution().toString()
    assert "TransformWithState" not in plan and "Python" not in plan
