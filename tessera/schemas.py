"""Schemas of the domain tables and the closed string domains of their columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(columns: str) -> T.StructType:
    """Columns as ``name type [not null]``; needs no session."""
    parts = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(p[0], _TYPES[p[1]], p[2:] != ["not", "null"]) for p in parts])


TABLES = {
    "workspaces": _schema("id long not null, root_path string not null, display_name string not null, status string not null, created_at timestamp not null, last_indexed_at timestamp"),
    "events": _schema("id long not null, event_type string not null, payload string not null, occurred_at timestamp not null"),
    "jobs": _schema("id long not null, job_type string not null, payload string not null, status string not null, priority int not null, retry_count int not null, max_retries int not null, created_at timestamp not null, started_at timestamp, completed_at timestamp, error string"),
    "documents": _schema("id long not null, workspace_id long not null, relative_path string not null, content_hash string not null, file_type string not null, size long not null, mtime timestamp not null, parse_status string not null, last_indexed_hash string, authored_at string"),
    "chunks": _schema("id long not null, document_id long not null, sequence_index int not null, text_content string not null, page_or_location_ref string not null, token_count int not null, parser_version string not null"),
    "embeddings_metadata": _schema("chunk_id long not null, vector_db_collection string not null, vector_id string not null, embedding_provider_id string not null, created_at timestamp not null"),
    "model_registry": _schema("id long not null, model_identifier string not null, engine_role string not null, capabilities string not null, context_length int not null, vram_requirement long, status string not null, version string not null, supported_tasks string not null, is_selected_for_role boolean not null"),
    "chat_sessions": _schema("id long not null, workspace_id long not null, document_id long, title string not null, mode string not null, created_at timestamp not null, updated_at timestamp not null"),
    "chat_messages": _schema("id long not null, session_id long not null, role string not null, content string not null, engine_pipeline_used string, created_at timestamp not null"),
    "annotations": _schema("id long not null, document_id long not null, location_ref string not null, content string not null, created_at timestamp not null, updated_at timestamp not null"),
    "bookmarks": _schema("id long not null, document_id long not null, location_ref string not null, label string not null, created_at timestamp not null"),
    "learning_progress": _schema("concept_node_id long not null, mastery_score double not null, weakness_score double not null, last_reviewed_at timestamp, attempt_count int not null"),
    "revision_history": _schema("id long not null, concept_node_id long not null, scheduled_at timestamp not null, completed_at timestamp, outcome string, created_at timestamp not null"),
    "analytics": _schema("id long not null, workspace_id long not null, metric_key string not null, metric_value double not null, computed_at timestamp not null, period string not null"),
    "settings": _schema("id long not null, key string not null, value string not null, value_type string not null, scope string not null, workspace_id long, updated_at timestamp not null"),
    "concept_nodes": _schema("id long not null, workspace_id long not null, label string not null, description string, created_at timestamp not null"),
    "concept_edges": _schema("id long not null, from_node_id long not null, to_node_id long not null, relation_type string not null, weight double not null"),
    "concept_node_sources": _schema("node_id long not null, document_id long not null"),
}

BLOCK = _schema("block_type string, page_or_location string, text_content string")

#: The closed domains.
DOMAINS = {
    "parse_status": ("pending", "parsing", "parsed", "parsed_empty", "failed"),
    "block_type": ("Heading", "Paragraph", "Image", "Table", "Code", "Equation"),
    "workspace_status": ("Unlinked", "Linking", "Indexing", "Active", "Archived"),
    "job_status": ("queued", "running", "succeeded", "failed", "cancelled"),
    "relation_type": ("prerequisite-of", "related-to", "part-of"),
    "engine_role": ("Vision", "OCR", "Embedding", "Retriever", "Reranker", "Reasoning", "Tutor", "Planner", "Memory", "Analytics"),
    "model_status": ("Available", "Loading", "Unavailable", "Error"),
    "chat_mode": ("normal", "research", "exam_restricted"),
    "chat_role": ("user", "assistant"),
    "revision_outcome": ("recalled", "forgotten"),
    "settings_scope": ("global", "workspace"),
    "value_type": ("string", "number", "bool", "json"),
}


def in_domain(value: Column, domain: str) -> Column:
    """Whether a value belongs to a closed domain (null does not)."""
    return F.coalesce(value.isin(*DOMAINS[domain]), F.lit(False))


def checked(value: Column, domain: str) -> Column:
    """The value; an unknown one stops the query."""
    return F.when(in_domain(value, domain), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {domain}: "), F.coalesce(value, F.lit("null")))))


def not_blank(value: Column) -> Column:
    """A required text holds more than white space."""
    return F.coalesce(F.length(F.trim(value)) > 0, F.lit(False))


def in_range(value: Column, least: int, most: int) -> Column:
    """A number lies in a closed range."""
    return F.coalesce(value.between(least, most), F.lit(False))


def setting_errors(key: Column, value_type: Column, scope: Column, workspace_id: Column) -> Column:
    """Array of what is wrong with a settings row; empty: valid."""
    return F.array_compact(
        F.array(
            F.when(~not_blank(key), F.lit("blank key")),
            F.when(~in_domain(value_type, "value_type"), F.lit("unknown value type")),
            F.when(~in_domain(scope, "settings_scope"), F.lit("unknown scope")),
            F.when((scope == "workspace") & workspace_id.isNull(), F.lit("workspace scope without workspace")),
            F.when((scope == "global") & workspace_id.isNotNull(), F.lit("global scope with workspace")),
        )
    )
