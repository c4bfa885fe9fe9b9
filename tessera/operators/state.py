"""Snapshot and delta merges, job and workspace state.

Upserts are full-outer merges of a snapshot and a delta to a new version; Parquet folders are
swapped as a whole by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import numbering
from tessera.operators.chunking import capped


def upsert(snapshot: DataFrame, delta: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of both; where a key (null-safe) is in both, the delta's. ``version`` orders several
    delta rows of one key."""
    columns = snapshot.columns
    if version is not None:
        latest = Window.partitionBy(*keys).orderBy(F.desc(version))
        delta = delta.withColumn("__n", F.row_number().over(latest)).filter("__n = 1")
    new, old = delta.select(*columns).alias("new"), snapshot.alias("old")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    marked = new.withColumn("__new", F.lit(True)).alias("new")
    return old.join(marked, same, "full_outer").select(*[F.when(F.col("__new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns])


def upsert_by_id(snapshot: DataFrame, delta: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """M1/M5: delta rows without an id (null or 0) are inserted under new ids, gap-free above all ids that either
    side names, in the given order of the delta; rows of a known id take its place, those of an unknown id
    are inserted with it."""
    named = F.coalesce(F.col(key), F.lit(0)) != 0
    top = snapshot.select(key).union(delta.select(key)).agg(F.max(key).alias("n")).first().n or 0
    fresh = numbering.numbered(delta.filter(~named).drop(key), order, key, top).select(*snapshot.columns)
    return upsert(snapshot, delta.filter(named).select(*snapshot.columns), [key]).unionByName(fresh)


def replace_rows(snapshot: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """M8: all rows of the delta's keys are replaced by the delta's."""
    return snapshot.join(delta.select(key).distinct(), key, "left_anti").select(*snapshot.columns).unionByName(delta.select(*snapshot.columns))


def without(snapshot: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows but those whose key is gone."""
    return snapshot.join(gone.select(key).distinct(), key, "left_anti")


def lookup(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of the wanted ids, in bulk; ids without a row are left out. A single id is a filter on the key."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def listed(table: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of each foreign key with their place in order."""
    return table.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def searchable(workspaces: DataFrame) -> DataFrame:
    """Workspaces that a search covers."""
    return workspaces.filter(F.col("status").isin("Active", "Indexing"))


def archived(status: Column) -> Column:
    """On which side of the archived split of a list a workspace stands."""
    return status == "Archived"


def extraction_totals(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Totals of what an extraction made (concepts, relations, sources, failed chunks or the like)."""
    return outcomes.groupBy(*by).agg(*[F.sum(c).alias(c) for c in outcomes.columns if c not in by])


def extraction_text(chunks: DataFrame, by: list[str], order: str, limit: int = 12_000) -> DataFrame:
    """chunks joined by blank lines until ``limit`` bytes are reached, cut there between characters."""
    row = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text_content") + 2).over(row), F.lit(0))
    held = chunks.withColumn("__before", before).filter(F.col("__before") < limit + 2)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text_content")))), lambda x: x["text_content"])
    return held.groupBy(*by).agg(F.array_join(texts, "\n\n").alias("t")).select(*by, capped(F.col("t"), limit).alias("extraction_text"))


def changed(files: DataFrame, documents: DataFrame, version: str | None = None, force: bool = False) -> DataFrame:
    """Incoming files whose content differs from what was indexed last, with the id held."""
    held = documents.select("workspace_id", "relative_path", "document_id", F.col("last_indexed_hash").alias("__last"))
    joined = files.join(held, ["workspace_id", "relative_path"], "left")
    own = F.col("content_hash") if version is None else F.concat_ws(":", "content_hash", F.lit(version))
    return (joined if force else joined.filter(~own.eqNullSafe(F.col("__last")))).drop("__last")


def parse_outcome(n_chunks: Column, error: Column) -> Column:
    """Parse status of a document."""
    return F.when(error.isNotNull(), "failed").when(n_chunks == 0, "parsed_empty").otherwise("parsed")


def indexing_status(jobs: DataFrame) -> DataFrame:
    """A1: progress of each workspace over its jobs (workspace_id, id, status, completed_at, payload)."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    done, total = n("succeeded") + n("failed"), n("queued") + n("running") + n("succeeded") + n("failed")
    return jobs.groupBy("workspace_id").agg(
        *[n(s).alias(s) for s in ("queued", "running", "succeeded", "failed")], total.alias("total"),
        F.when(total > 0, F.round(done * 1000.0 / total) / 10).alias("percent"),
        F.max(F.when(F.col("status") == "succeeded", F.col("completed_at"))).alias("last_completed_at"),
        F.min(F.when(F.col("status") == "running", F.col("id"))).alias("running_id"),
    )


def next_jobs(jobs: DataFrame, by: list[str]) -> DataFrame:
    """The queued job of highest priority, then least id, of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc("priority"), "id")
    return jobs.filter("status = 'queued'").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def resumable(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs; running ones without a worker are queued again."""
    return jobs.filter(F.col("status").isin("queued", "running")).withColumn("status", F.lit("queued"))


def job_fold(transitions: Column, max_retries: int = 3) -> Column:
    """State after a job's ordered transitions (running, succeeded, failed, cancelled).

    A failure counts a retry and queues the job again while retries are left.
    """
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("retry_count"))

    def step(s: Column, t: Column) -> Column:
        retries = s["retry_count"] + F.when(t == "failed", 1).otherwise(0)
        status = F.when(t == "failed", F.when(retries <= max_retries, "queued").otherwise("failed")).otherwise(t)
        return F.struct(status.alias("status"), retries.alias("retry_count"))

    return F.aggregate(transitions, start, step)


def job_folded(transitions: DataFrame, by: list[str], order: list[str], status: str, max_retries: int = 3) -> DataFrame:
    """M10/R7 as :func:`job_fold`, by aggregates that tasks combine before the shuffle: the state
    follows from the last transition (nulls of ``order`` last) and the number of failures."""
    place = F.struct(*[c for o in order for c in (F.col(o).isNull(), F.col(o))])
    held = transitions.groupBy(*by).agg(F.max_by(status, place).alias("last"), F.count_if(F.col(status) == "failed").cast("int").alias("retry_count"))
    again = F.when(F.col("retry_count") <= max_retries, "queued").otherwise("failed")
    return held.select(*by, F.when(F.col("last") == "failed", again).otherwise(F.col("last")).alias("status"), "retry_count")


def workspace_fold(actions: Column) -> Column:
    """Status after ordered actions (link, archive, restore, unlink) and the number refused."""
    start = F.struct(F.lit("Unlinked").alias("status"), F.lit(0).alias("refused"))

    def step(s: Column, a: Column) -> Column:
        was = s["status"]
        new = F.when((a == "link") & (was == "Unlinked"), "Active").when((a == "archive") & (was != "Unlinked"), "Archived").when((a == "restore") & (was == "Archived"), "Active").when((a == "unlink") & (was != "Unlinked"), "Unlinked")
        return F.struct(F.coalesce(new, was).alias("status"), (s["refused"] + new.isNull().cast("int")).alias("refused"))

    return F.aggregate(actions, start, step)


def workspaces_folded(actions: DataFrame, by: list[str], order: list[str], action: str) -> DataFrame:
    """M11 as :func:`workspace_fold`, by running windows and aggregates instead of one list per key.

    A workspace is linked after ``link`` and not after ``unlink``; while it is linked the last of link
    (where it was not), archive and restore tells its status.
    """
    a, run = F.col(action), Window.partitionBy(*by).orderBy(*order)
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    linked = F.coalesce(F.last(F.when(a.isin("link", "unlink"), a == "link"), ignorenulls=True).over(earlier), F.lit(False))
    held = actions.withColumn("__linked", linked)
    turned = F.when(a == "unlink", "Unlinked").when((a == "link") & ~F.col("__linked"), "Active").when((a == "archive") & F.col("__linked"), "Archived").when((a == "restore") & F.col("__linked"), "Active")
    held = held.withColumn("__turned", turned).withColumn("__was", F.coalesce(F.last("__turned", ignorenulls=True).over(earlier), F.lit("Unlinked")))
    refused = F.when(a == "link", F.col("__linked")).when(a == "restore", F.col("__was") != "Archived").when(a.isin("archive", "unlink"), ~F.col("__linked")).otherwise(True)
    after = F.coalesce("__turned", "__was")
    place = F.struct(*[c for o in order for c in (F.col(o).isNotNull(), F.col(o))])
    return held.groupBy(*by).agg(F.max_by(after, place).alias("status"), F.count_if(refused).cast("int").alias("refused"))


def recent_documents(opened: DataFrame, by: list[str], limit: int = 10) -> DataFrame:
    """The documents opened last, each once."""
    last = opened.groupBy(*by, "document_id").agg(F.max("at").alias("at"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("at"), "document_id"))).filter(F.col("place") <= limit)


def vector_ids(chunks: DataFrame) -> DataFrame:
    """M7: collection and vector id of each chunk."""
    collection = F.concat(F.lit("workspace-"), F.col("workspace_id").cast("string"))
    return chunks.withColumns({"vector_db_collection": collection, "vector_id": F.concat(collection, F.lit(":"), F.col("chunk_id").cast("string"))})
