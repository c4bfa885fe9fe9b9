"""Domain frames derived from the given tables, and the same as common table expressions.

Workspaces are the sources of documents; chunks come from their texts; jobs from orders; the
concept graph from parts and consecutive lines of orders; models from suppliers; settings from
regions and nations; changes from events; quizzes from labels.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import json_ops
from tessera.operators import chunking
from tessera.sources import staging


#: Distance of two documents' first chunk ids: no document has so many chunks.
CHUNKS_APART = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("document_id"), F.substring("source", 4, 9).cast("long").alias("workspace_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"),
        F.sha2(text, 256).alias("content_hash"), F.octet_length(text).cast("long").alias("size"), text.alias("text"),
    )


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("source").distinct()
    return own.select(F.substring("source", 4, 9).cast("long").alias("workspace_id"), F.concat(F.lit("Workspace "), F.substring("source", 4, 9)).alias("display_name"))


def chunks(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    """Chunks of all documents; with ``hits`` (chunk_id, a stored table) those of the documents that are hit only."""
    held = documents(spark, sf_dir)
    if hits is not None:
        held = held.join(hits.select(F.shiftright("chunk_id", CHUNKS_APART.bit_length() - 1).alias("document_id")).distinct(), "document_id", "left_semi")
    blocks = held.select("document_id", "workspace_id", F.col("text").alias("text_content"), F.lit("1").alias("page_or_location"))
    made = chunking.chunk_blocks(blocks, ["document_id", "workspace_id"])
    return made.withColumn("chunk_id", F.col("document_id") * CHUNKS_APART + F.col("sequence_index"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole text of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("succeeded")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("workspace_id"), status.alias("status"), (5 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"), F.when(status == "succeeded", F.col("o_orderdate")).alias("completed_at"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 10).alias("workspace_id"), F.col("p_name").alias("label"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links between parts of consecutive lines of an order; dealt by order, then by their start, in parts of bounded size."""
    lines = table(spark, sf_dir, "lineitem")
    n = staging.parts(lines)
    li = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(n, "l_orderkey").distinct()
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kinds = F.element_at(F.array(*[F.lit(r) for r in ("prerequisite-of", "related-to", "part-of")]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    linked = li.select(F.col("l_partkey").alias("from_node_id"), F.lead("l_partkey").over(order).alias("to_node_id"), kinds.alias("relation_type")).filter("to_node_id IS NOT NULL AND to_node_id <> from_node_id")
    return linked.repartition(n, "from_node_id").distinct()


def edge_id() -> Column:
    return F.concat_ws("-", F.col("from_node_id").cast("string"), F.col("to_node_id").cast("string"), "relation_type")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).withColumn("edge_id", edge_id())


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of nodes as often as they are recorded."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("document_id"))


def node_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each once; dealt by node in parts of bounded size."""
    s = recorded(spark, sf_dir)
    return s.repartition(staging.parts(s), "node_id").distinct()


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows: one for each supplier, its nation tells role and capabilities."""
    s = table(spark, sf_dir, "supplier")
    caps = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("TextGeneration"))).when(F.col("s_nationkey") % 3 == 1, F.array(F.lit("TextGeneration"), F.lit("Vision"))).otherwise(F.array(F.lit("TextGeneration"), F.lit("Embedding")))
    return s.select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("model_identifier"), caps.alias("capabilities"), (F.col("s_nationkey") * 512 + 2048).cast("int").alias("context_length"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit(None)).otherwise(F.concat((F.col("s_suppkey") % 70).cast("string"), F.lit("B"))).alias("parameter_size"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Removed").otherwise("Modified")
    at = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return e.select(F.col("user_id").alias("path"), kind.alias("kind"), at.alias("at_ms"), F.col("event_id").alias("seq"))


def worker_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index jobs of events: errors are of an unknown type, some payloads lack their path."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(json_ops.payload_long(F.col("props"), "k"), F.lit(0))
    path = F.when(k % 10 != 9, F.concat(F.lit("k"), k.cast("string")))
    priority = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    at = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return e.select(
        F.col("user_id").alias("workspace_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "reindex_all").otherwise("index_document").alias("job_type"),
        json_ops.payload(workspace_id=F.col("user_id"), relative_path=path).alias("payload"), priority.alias("priority"), F.lit(3).alias("max_retries"), at.alias("at_ms"),
    )


def run_job(payload: str, failures: int) -> tuple[str, str | None]:
    """A stand-in for indexing: a file of number k is busy k % 6 times, and unchanged where k is a multiple of four."""
    path = json.loads(payload)["relative_path"]
    k = int(path[1:])
    if failures < k % 6:
        return "failed", f"file {path} is busy"
    return ("unchanged" if k % 4 == 0 else "indexed"), None


CTE = {
    "d": "SELECT doc_id AS document_id, CAST(substr(source, 4) AS BIGINT) AS workspace_id, source || '/' || doc_id || '.txt' AS relative_path, sha256(coalesce(text, '')) AS content_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, coalesce(text, '') AS text FROM documents",
    "ws": "SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS workspace_id, 'Workspace ' || substr(source, 4) AS display_name FROM documents",
    "cw": r"SELECT document_id, workspace_id, flatten(list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: CASE WHEN strlen(w) <= 64 THEN [w] ELSE list_transform(range(CAST(ceil(length(w) / CAST(CASE WHEN strlen(w) = length(w) THEN 64 ELSE 16 END AS DOUBLE)) AS BIGINT)), lambda i: substr(w, i * CASE WHEN strlen(w) = length(w) THEN 64 ELSE 16 END + 1, CASE WHEN strlen(w) = length(w) THEN 64 ELSE 16 END)) END)) AS w FROM d",
    "cx": "SELECT document_id, workspace_id, CAST(k AS INTEGER) AS sequence_index, array_to_string(w[k * 224 + 1 : k * 224 + 256], ' ') AS whole, CAST(least(len(w) - k * 224, 256) AS INTEGER) AS token_count, document_id * 1048576 + k AS chunk_id FROM (SELECT *, unnest(generate_series(0, CAST(ceil(greatest(len(w) - 256, 0) / 224.0) AS BIGINT))) AS k FROM cw WHERE len(w) > 0)",
    "c": "SELECT document_id, workspace_id, sequence_index, token_count, chunk_id, CASE WHEN strlen(whole) <= 4000 THEN whole ELSE left(whole, list_max(list_filter(range(1000, 4001), lambda k: strlen(left(whole, k)) <= 4000))) END AS text_content FROM cx",
    "q": "SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark",
    "qt": r"SELECT query_id, query, list_filter(string_split_regex(lower(query), '\s+'), lambda w: w <> '') AS terms FROM q",
    "kw": "SELECT query_id, query, terms, chunk_id, document_id, workspace_id, sequence_index, token_count, text_content, n / CAST(len(terms) AS DOUBLE) AS score FROM (SELECT *, len(list_filter(terms, lambda t: contains(low, t))) AS n FROM (SELECT *, lower(text_content) AS low FROM c) c, qt) WHERE n > 0",
    "kwr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kw",
    "jobs": "SELECT o_orderkey AS id, o_custkey % 10 AS workspace_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'succeeded' END END AS status, 5 - CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, CASE WHEN o_orderstatus NOT IN ('O', 'P') AND o_orderkey % 7 <> 0 THEN o_orderdate END AS completed_at FROM orders",
    "n": "SELECT p_partkey AS node_id, p_partkey % 10 AS workspace_id, p_name AS label FROM part",
    "e": "SELECT DISTINCT f AS from_node_id, t AS to_node_id, r AS relation_type, f || '-' || t || '-' || r AS edge_id FROM (SELECT l_partkey AS f, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t, ['prerequisite-of', 'related-to', 'part-of'][l_linenumber % 3 + 1] AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)) WHERE t IS NOT NULL AND t <> f",
    "src": "SELECT DISTINCT l_partkey AS node_id, l_orderkey AS document_id FROM lineitem",
    "m": "SELECT s_suppkey AS pos, s_name AS model_identifier, CASE s_nationkey % 3 WHEN 0 THEN ['TextGeneration'] WHEN 1 THEN ['TextGeneration', 'Vision'] ELSE ['TextGeneration', 'Embedding'] END AS capabilities, CAST(s_nationkey * 512 + 2048 AS INTEGER) AS context_length, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 70) || 'B' END AS parameter_size FROM supplier",
    "mr": "SELECT *, unnest(CASE WHEN list_contains(capabilities, 'Vision') THEN ['Tutor', 'Reasoning', 'Planner', 'Vision'] WHEN list_contains(capabilities, 'Embedding') THEN ['Tutor', 'Reasoning', 'Planner', 'Embedding'] ELSE ['Tutor', 'Reasoning', 'Planner'] END) AS engine_role FROM m",
    "wj": "SELECT user_id AS workspace_id, event_id AS id, k, event_type = 'error' AS odd, k % 10 = 9 AS bare, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS priority, epoch_us(ts) // 1000 AS at_ms FROM (SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)",
    "ch": "SELECT user_id AS path, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Removed' ELSE 'Modified' END AS kind, epoch_us(ts) // 1000 AS at_ms, event_id AS seq FROM events",
}
NEEDS = {"cw": ("d",), "cx": ("cw",), "c": ("cx",), "qt": ("q",), "kw": ("c", "qt"), "kwr": ("kw",), "mr": ("m",)}


def with_ctes(names: str, body: str) -> str:
    """SQL with the named expressions and those they need."""
    held: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in held:
            held.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in held) + "\n" + body
