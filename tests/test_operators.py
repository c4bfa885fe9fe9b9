"""Small cases of the operators, stream against batch, and plan checks."""

import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, context, graph, registry, search, state, study
from tessera.plans import catalog, domain
from tessera.sources import files, staging
from tessera.streaming import debounce, events


def chunked(spark, text, **options):
    df = spark.createDataFrame([(1, text, "1")], "document_id long, text_content string, page_or_location string")
    return [r.asDict() for r in chunking.chunk_blocks(df, ["document_id"], **options).orderBy("sequence_index").collect()]


def test_chunks_overlap(spark):
    got = chunked(spark, " ".join(f"w{i}" for i in range(20)), window=10, overlap=3)
    assert got[0]["text_content"].split()[-3:] == got[1]["text_content"].split()[:3]
    assert [c["token_count"] for c in got] == [10, 10, 6]
    assert len(chunked(spark, "one two three", window=10, overlap=2)) == 1
    assert chunked(spark, "  \n ") == []


def test_long_words_are_cut_between_characters(spark):
    got = chunked(spark, "a" * 200)
    assert [len(w) for w in got[0]["text_content"].split()] == [64, 64, 64, 8] and got[0]["token_count"] == 4
    wide = chunked(spark, "é" * 100)[0]["text_content"]
    assert wide.replace(" ", "") == "é" * 100 and all(len(w.encode()) <= 64 for w in wide.split())


def test_byte_cap_cuts_between_characters(spark):
    got = chunked(spark, " ".join(["é" * 16] * 200), max_bytes=4000)
    assert len(got[0]["text_content"].encode()) <= 4000 and got[0]["token_count"] == 200
    assert "�" not in got[0]["text_content"]


def test_blocks_share_one_sequence(spark):
    df = spark.createDataFrame([(1, 0, "a b c", "1"), (1, 1, "d e f", "2")], "document_id long, pos int, text_content string, page_or_location string")
    got = chunking.chunk_blocks(df, ["document_id"], window=2, overlap=0, order="pos").orderBy("sequence_index").collect()
    assert [(r.sequence_index, r.text_content, r.page_or_location_ref) for r in got] == [(0, "a b", "1"), (1, "c", "1"), (2, "d e", "2"), (3, "f", "2")]


def hits(spark, rows):
    return spark.createDataFrame([(1, r, c, d, t, 1.0 / (r + 1)) for r, c, d, t in rows], "query_id long, rank int, chunk_id long, document_id long, text_content string, score double")


def test_hybrid_weights(spark):
    schema = "query_id long, chunk_id long, score double"
    keyword = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.2)], schema)
    vector = spark.createDataFrame([(1, 2, 1.0)], schema)
    got = {r.chunk_id: r.score for r in search.merged(keyword, vector).collect()}
    assert got == pytest.approx({2: 0.68, 1: 0.40})


def test_context_steps(spark):
    h = hits(spark, [(1, 5, 1, "Some  text here"), (2, 9, 1, "some text HERE"), (3, 1, 1, "other words entirely"), (4, 2, 1, "next to one"), (5, 5, 1, "Some  text here")])
    by = ["query_id"]
    assert context.exact_dedup(h, by).count() == 4
    assert sorted(r.chunk_id for r in context.near_dedup(context.exact_dedup(h, by), by).collect()) == [1, 2, 5]
    budget = context.token_budget(h, by, 3).collect()
    assert len(budget) == 1 and budget[0].total_tokens == 3
    assert context.token_budget(h, by, 1).count() == 1
    merged = {r.chunk_id: (r.text_content, r.n_merged) for r in context.merge_adjacent(context.exact_dedup(h, by), by).collect()}
    assert merged[1] == ("other words entirely\nnext to one", 2) and len(merged) == 3
    assert [r.number for r in context.citations(h, by).orderBy("number").collect()] == [1, 2, 3, 4, 5]


def test_queries_without_words_find_nothing(spark):
    chunks = spark.createDataFrame([(1, "x y")], "chunk_id long, text_content string")
    queries = spark.createDataFrame([(1, "  "), (2, None)], "query_id long, query string")
    assert search.keyword_hits(chunks, queries).count() == 0


def test_citation_graph(spark):
    nodes = spark.createDataFrame([(1, 1, "A"), (2, 1, "B"), (3, 2, "C")], "node_id long, workspace_id long, label string")
    edges = spark.createDataFrame([("e", 1, 2, "related-to"), ("f", 1, 3, "part-of")], "edge_id string, from_node_id long, to_node_id long, relation_type string")
    sources = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "node_id long, document_id long")
    chosen = spark.createDataFrame([(1,)], "workspace_id long")
    got = graph.citation_edges(edges, nodes, sources, chosen).collect()
    assert [(r.edge_id, r.source_documents) for r in got] == [("e", [1, 2])]
    assert graph.edge_ends(graph.citation_edges(edges, nodes, sources, chosen)).count() == 2
    assert "Generate" not in graph.citation_edges(edges, nodes, sources, chosen)._jdf.queryExecution().toString()  # no rows of edge and document


def test_relations_and_labels(spark):
    nodes = spark.createDataFrame([(1, 1, "Alpha"), (2, 1, "beta")], "node_id long, workspace_id long, label string")
    relations = spark.createDataFrame([(1, " ALPHA ", "Beta", "part-of"), (1, "alpha", "Alpha", "part-of"), (1, "alpha", "beta", "unknown")], "workspace_id long, from_label string, to_label string, relation_type string")
    got = graph.resolved_relations(relations, nodes).collect()
    assert [(r.from_node_id, r.to_node_id) for r in got] == [(1, 2)]
    fresh = spark.createDataFrame([(1, "ALPHA"), (1, "Gamma"), (1, "gamma "), (1, " ")], "workspace_id long, label string")
    assert [r.label for r in graph.new_nodes(fresh, nodes).collect()] == ["Gamma"]


def test_job_state(spark):
    jobs = spark.createDataFrame([(1, 1, "queued", None), (1, 2, "queued", None), (2, 3, "succeeded", 5)], "workspace_id long, id long, status string, completed_at long")
    got = {r.workspace_id: (r.queued, r.total, r.percent) for r in state.indexing_status(jobs).collect()}
    assert got == {1: (2, 2, 0.0), 2: (0, 1, 100.0)}
    folded = lambda *t: tuple(spark.range(1).select(state.job_fold(F.array(*[F.lit(x) for x in t])).alias("x")).first().x)
    assert folded("running", "failed", "running", "succeeded") == ("succeeded", 1)
    assert folded(*["failed"] * 4) == ("failed", 4)
    assert tuple(spark.range(1).select(state.workspace_fold(F.array(*[F.lit(a) for a in ("link", "restore", "archive", "archive", "restore")])).alias("x")).first().x) == ("Active", 1)


def test_upsert_is_null_safe(spark):
    schema = "key string, workspace_id long, value string"
    old = spark.createDataFrame([("k", None, "a"), ("k", 1, "b")], schema)
    new = spark.createDataFrame([("k", None, "c"), ("j", None, "d")], schema)
    got = sorted(map(tuple, state.upsert(old, new, ["key", "workspace_id"]).collect()), key=repr)
    assert got == [("j", None, "d"), ("k", 1, "b"), ("k", None, "c")]


def test_quiz_and_progress(spark):
    attempts = spark.createDataFrame([("q", 0, 0), ("q", 1, None)], "quiz string, correct int, selected int")
    r = study.graded(attempts, ["quiz"]).first()
    assert (r.correct_count, r.total, r.score) == (1, 2, 0.5)
    results = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.75)], "concept_node_id long, at long, score double")
    p = study.progressed(results).first()
    assert (p.mastery_score, p.weakness_score, p.attempt_count) == (0.75, 0.25, 2)


def test_best_model_and_settings(spark):
    models = spark.createDataFrame([(i, f"m{i}", ["TextGeneration"], 4096, s) for i, s in enumerate(("8B", "8B", "12B", "8B", None))], "pos long, model_identifier string, capabilities array<string>, context_length int, parameter_size string")
    assert {r.model_identifier for r in registry.best_per_role(registry.candidates(models)).collect()} == {"m2"}
    entries = spark.createDataFrame([("default", "k", None, "a"), ("user", "k", None, "b"), ("default", "k", 1, "c")], "layer string, key string, workspace_id long, value string")
    ws = spark.createDataFrame([(1,), (2,)], "workspace_id long")
    assert {r.workspace_id: r.value for r in registry.resolved_settings(entries, ws).collect()} == {1: "b", 2: "b"}
    assert spark.range(1).select(registry.terminal_role(registry.route(F.lit("nonsense"))).alias("x")).first().x == "Tutor"


def changes(spark, rows):
    return spark.createDataFrame([(p, k, at, i) for i, (p, k, at) in enumerate(rows)], "path string, kind string, at_ms long, seq long")


CASES = [
    ("a", "Created", 0), ("b", "Modified", 0), ("b", "Modified", 10), ("b", "Modified", 20), ("c", "Created", 0), ("c", "Removed", 10),
    ("d", "Modified", 0), ("d", "Removed", 10), ("e", "Modified", 0), ("e", "Created", 5000), ("f", "Created", 0), ("f", "Removed", 1), ("f", "Removed", 2),
]
WANT = [("a", "Added", 0), ("b", "Updated", 20), ("d", "Deleted", 10), ("e", "Added", 5000), ("e", "Updated", 0), ("f", "Deleted", 2)]


def test_debounce_batch(spark):
    assert sorted(map(tuple, debounce.debounced(changes(spark, CASES), 100).collect())) == WANT


def test_debounce_stream_equals_batch(spark, tmp_path):
    flush = [("z", "Modified", 10_000_000)]
    source = str(tmp_path / "in")
    changes(spark, CASES).withColumn("at", F.timestamp_millis(F.col("at_ms") + 1_000_000)).coalesce(1).write.parquet(source)
    changes(spark, flush).withColumn("at", F.timestamp_millis(F.col("at_ms") + 1_000_000)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("path string, kind string, at_ms long, seq long, at timestamp").option("maxFilesPerTrigger", 1).parquet(source).withWatermark("at", "0 seconds")
    query = debounce.debounce_stream(stream, 100).writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(tuple(r) for r in spark.table("debounced").collect() if r.path != "z") == WANT


def test_changes_are_published_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "Added"), ("b", "Deleted")], "path string, kind string").write.parquet(source)
    stream = spark.readStream.schema("path string, kind string").parquet(source)
    events.publish(stream, 7, str(tmp_path / "events"), str(tmp_path / "jobs"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2
    assert [r.payload for r in spark.read.parquet(str(tmp_path / "jobs")).collect()] == ['{"workspace_id":7,"relative_path":"a"}']


def test_files_are_scanned_and_parsed(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.png").write_bytes(b"\x89PNG")
    scanned = files.scan(spark, str(tmp_path))
    got = {r.relative_path: ([tuple(b) for b in r.blocks], r.error) for r in files.parsed(scanned).collect()}
    assert got["sub/a.md"][0] == [("Heading", "1", "T"), ("Paragraph", "3", "body")]
    assert [b[2] for b in got["b.txt"][0]] == ["one", "two"] and got["c.xyz"] == ([], "no parser")
    assert got["d.png"][0] == [("Image", "1", "")] and len(got) == 4
    assert files.fingerprint(scanned).count() == 4


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"part={k}").mkdir()
        (tmp_path / f"part={k}" / "a.txt").write_text(str(k))
    before, context = spark.conf.get(files.LISTING_TASKS), spark.sparkContext
    context.setJobGroup("listing", "")
    try:
        scanned = files.scan(spark, str(tmp_path))
        jobs = context.statusTracker().getJobIdsForGroup("listing")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = [context.statusTracker().getStageInfo(i) for j in jobs for i in context.statusTracker().getJobInfo(j).stageIds]
    assert sum(i.numTasks for i in stages) <= context.defaultParallelism and spark.conf.get(files.LISTING_TASKS) == before
    assert scanned.count() == 40


def test_a_tree_is_written_by_all_cores_without_checksum_files(spark, sf):
    path = Path(catalog._tree(spark, domain.table(spark, sf, "documents")).removeprefix("file://"))
    names = [p.name for p in path.glob("source=*/part=*/*")] + [p.name for p in path.glob("source=*/part=*/.*")]
    assert len({n.split("-")[1] for n in names if n.startswith("part-")}) > 1 and not [n for n in names if n.endswith(".crc")]


def test_scanned_files_are_read_once(spark, sf):
    plan = catalog.scanned_files(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "Join" not in plan


def test_a_tasks_scores_of_vectors_stay_small_with_many_queries():
    rng = np.random.default_rng(1)
    asked, rows, ids = rng.normal(size=(1000, 4)), rng.normal(size=(9000, 4)), np.arange(5000, 14000)
    sent = SimpleNamespace(value=search.VectorBlock([(k, list(v), 0) for k, v in enumerate(asked)]))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(rows)), pa.array(np.zeros(len(rows), dtype=np.int64))], names=["chunk_id", "vector", "group"])
    tracemalloc.start()
    (found,) = search._nearest(sent, 3)([batch])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6
    cosines = np.round((rows / np.linalg.norm(rows, axis=1)[:, None]) @ (asked / np.linalg.norm(asked, axis=1)[:, None]).T, 6)
    want = [int(ids[i]) for k in range(1000) for i in np.lexsort((ids, -cosines[:, k]))[:3]]
    assert found.column("chunk_id").to_pylist() == want


def test_best_keeps_the_smaller_ids_of_equal_scores():
    best = search.Best(2, 2)
    best.add(np.array([[0.5, -np.inf], [0.5, -np.inf], [0.25, -np.inf]]), np.array([7, 9, 1]))
    best.add(np.array([[0.5, 0.0], [0.5, -np.inf]]), np.array([8, 10]))
    assert best.chunk[0].tolist() == [7, 8] and best.score[0].tolist() == [0.5, 0.5]
    assert best.chunk[1, 0] == 8 and best.score[1].tolist() == [0.0, -np.inf]


def test_texts_of_hits_come_from_documents_that_are_hit(spark, sf):
    first = domain.chunks(spark, sf).filter("sequence_index = 1").limit(3).select("chunk_id", "document_id").collect()
    hits = staging.stored(spark.createDataFrame([(r.chunk_id,) for r in first], "chunk_id long"), "hits")
    every, own = domain.chunks(spark, sf), domain.chunks(spark, sf, hits)
    assert {r.document_id for r in own.select("document_id").collect()} == {r.document_id for r in first}
    assert sorted(own.collect()) == sorted(every.join(own.select("document_id").distinct(), "document_id", "left_semi").select(*own.columns).collect())


def test_words_are_made_once_for_all_chunks_of_a_block(spark, sf):
    plan = domain.chunks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Generate explode(sequence" not in plan


def test_plans_push_down_and_stay_in_the_jvm(spark, sf):
    plan = lambda df: df._jdf.queryExecution().toString()
    keyword = plan(catalog.keyword_topk(spark, sf))
    assert "BroadcastNestedLoopJoin" not in keyword and "Python" not in keyword and "WindowGroupLimit" in keyword
    assert "CartesianProduct" not in plan(catalog.vector_topk(spark, sf))
    docs = plan(domain.documents(spark, sf).filter("document_id < 5").select("relative_path"))
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,5)]" in docs and "text:string" not in docs.split("ReadSchema")[1]


def test_questions_come_out_with_what_is_wrong(spark):
    rows = [
        (1, '```json\n{"questions": [{"question": "q", "options": ["a"], "correct_index": 0}, {"question": null, "options": ["a"], "correct_index": 0}, {"options": "a"}]}\n```'),
        (2, '{"questions": []}'), (3, '{"questions": {}}'), (4, "[1]"), (5, None), (6, ""), (7, '{"questions": [7, {"question": "q", "options": null, "correct_index": 0}, {"question": "q", "options": ["a"], "correct_index": -1}]}'),
    ]
    got = [(r.id, r.pos, r.reason) for r in study.checked_questions(spark.createDataFrame(rows, "id long, raw string"), "raw").orderBy("id", "pos").collect()]
    assert got == [
        (1, 0, None), (1, 1, "no question"), (1, 2, "no question"), (3, None, "no questions"), (4, None, "no questions"), (5, None, "no JSON"), (6, None, "no JSON"),
        (7, 0, "no question"), (7, 1, "no options"), (7, 2, "no correct option"),
    ]


def test_ledger_finds_each_change_once(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, None)], "relative_path string, size long, mtime long")
    new = spark.createDataFrame([("a", 1, 6), ("c", 1, None), ("d", 0, 1)], "relative_path string, size long, mtime long")
    assert sorted(map(tuple, files.ledger_changes(old, new, ["size", "mtime"]).collect())) == [("a", "Changed"), ("b", "Removed"), ("d", "Added")]
    assert files.ledger_changes(new, new, ["size", "mtime"]).count() == 0 and files.ledger_changes(old.limit(0), old, ["size"]).count() == 3


def test_vectors_of_odd_rows_score_zero(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [2.0, 0.1]), (None, [1.0, 0.0])], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (9, [3.0])], "query_id long, qv array<double>")
    got = {(r.query_id, r.chunk_id): r.score for r in search.vector_hits(rows, queries, 10).collect()}
    assert got == {(1, 6): 0.998752, (1, 2): 0.0, (1, 3): 0.0, (1, 4): 0.0, (1, 5): 0.0, (9, 3): 1.0, (9, 1): 0.0, (9, 2): 0.0, (9, 4): 0.0, (9, 5): 0.0, (9, 6): 0.0}
    assert search.vector_hits(rows.limit(0), queries, 10).count() == 0 and search.vector_hits(rows, queries.limit(0), 10).count() == 0
    best = search.vector_hits(rows, spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10, 15)], "query_id long, qv array<double>"), 1, block=2)
    assert best.count() == 5 and {r["rank"] for r in best.collect()} == {1}


def test_sources_are_found_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(staging, "PART_ROWS", 100)
    held = spark.range(2000).selectExpr("id % 50 AS node_id", "id % 200 AS document_id")
    got = graph.recorded_sources(held, held)
    assert got.count() == 200 and got.rdd.getNumPartitions() == 40


def test_edges_and_their_ends_are_found_in_parts_of_bounded_size(spark, sf, monkeypatch):
    monkeypatch.setattr(staging, "PART_ROWS", 500)
    n = -(-domain.table(spark, sf, "lineitem").count() // 500)
    assert n > 4 and domain.links(spark, sf).rdd.getNumPartitions() == domain.edges(spark, sf).rdd.getNumPartitions() == n
    plan = catalog.QUERIES["edge_end_nodes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(to_node_id") >= 2 and f", {n})" in plan
