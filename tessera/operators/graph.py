"""Concept graph."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import numbering
from tessera.sources import staging

RELATIONS = ("prerequisite-of", "related-to", "part-of")


def label_key(label: Column) -> Column:
    """P5: labels are equal but for white space around them and the case of ASCII letters."""
    return F.translate(F.trim(label), string.ascii_uppercase, string.ascii_lowercase)


def workspace_edges(edges: DataFrame, nodes: DataFrame, workspace: int | None = None) -> DataFrame:
    """Edges whose start lies in a workspace (all, with their workspace, if none is named)."""
    own = nodes.select(F.col("node_id").alias("from_node_id"), "workspace_id")
    return edges.join(own if workspace is None else own.filter(F.col("workspace_id") == workspace), "from_node_id")


def node_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges at each of the given nodes, by an equi-join on both ends, each once per node."""
    ends = edges.select("*", F.explode(F.array_distinct(F.array("from_node_id", "to_node_id"))).alias("node_id"))
    return ends.join(nodes.select("node_id").distinct(), "node_id")


def citation_edges(edges: DataFrame, nodes: DataFrame, sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges (each given once) with an end in the chosen workspaces whose ends come from two documents or more,
    with those documents sorted.

    A node's documents become one array first; an edge meets the arrays of its two ends, so no row of edge and
    document is ever written down."""
    held = sources.groupBy("node_id").agg(F.collect_set("document_id").alias("documents"))
    picked = chosen.select("workspace_id").distinct().withColumn("picked", F.lit(True))
    known = nodes.join(picked, "workspace_id", "left").select("node_id", "label", F.coalesce("picked", F.lit(False)).alias("picked")).join(held, "node_id", "left")

    def end(name: str) -> DataFrame:
        return known.select(F.col("node_id").alias(f"{name}_node_id"), F.col("label").alias(f"{name}_label"), F.col("picked").alias(f"__{name}_picked"), F.coalesce("documents", F.array().cast(held.schema["documents"].dataType)).alias(f"__{name}_documents"))

    own = edges.join(end("from"), "from_node_id").join(end("to"), "to_node_id").filter("__from_picked OR __to_picked")
    documents = F.array_sort(F.array_union("__from_documents", "__to_documents"))
    return own.withColumn("source_documents", documents).filter(F.size("source_documents") > 1).drop("__from_picked", "__to_picked", "__from_documents", "__to_documents")


def new_nodes(extracted: DataFrame, existing: DataFrame) -> DataFrame:
    """Extracted labels (workspace_id, label) not yet in the graph, each once."""
    fresh = extracted.withColumn("key", label_key(F.col("label"))).filter("key <> ''")
    held = existing.select("workspace_id", label_key(F.col("label")).alias("key"))
    return fresh.join(held, ["workspace_id", "key"], "left_anti").groupBy("workspace_id", "key").agg(F.min("label").alias("label")).drop("key")


def resolved_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations by label as edges by node; unknown ends or types and self-loops drop out."""
    known = nodes.groupBy("workspace_id", label_key(F.col("label")).alias("key")).agg(F.min("node_id").alias("node_id"))
    named = relations.filter(F.col("relation_type").isin(*RELATIONS)).withColumns({"fk": label_key(F.col("from_label")), "tk": label_key(F.col("to_label"))})
    start = known.select("workspace_id", F.col("key").alias("fk"), F.col("node_id").alias("from_node_id"))
    end = known.select("workspace_id", F.col("key").alias("tk"), F.col("node_id").alias("to_node_id"))
    return named.join(start, ["workspace_id", "fk"]).join(end, ["workspace_id", "tk"]).filter("from_node_id <> to_node_id").drop("fk", "tk")


def new_edges(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges not yet in the graph, each once."""
    key = ["from_node_id", "to_node_id", "relation_type"]
    return candidates.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def recorded_sources(existing: DataFrame, added: DataFrame) -> DataFrame:
    """U4: set of (node_id, document_id), found in parts of bounded size."""
    both = existing.select("node_id", "document_id").union(added.select("node_id", "document_id"))
    return both.repartition(staging.parts(both), "node_id", "document_id").distinct()


def edge_ends(edges: DataFrame) -> DataFrame:
    """The distinct nodes of labelled edges, the least label first."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_node_id").alias("node_id"), F.col("from_label").alias("label")), F.struct(F.col("to_node_id").alias("node_id"), F.col("to_label").alias("label")))).alias("x"))
    return ends.groupBy("x.node_id").agg(F.min("x.label").alias("label"))


def inserted_nodes(extracted: DataFrame, existing: DataFrame) -> DataFrame:
    """The new nodes of extracted labels with ids of their own, gap-free above those held, in order of
    workspace and label."""
    top = existing.agg(F.max("node_id").alias("n")).first().n or 0
    fresh = new_nodes(extracted, existing)
    return numbering.numbered(fresh, [F.col("workspace_id"), F.col("label")], "node_id", top)


def circular_layout(nodes: DataFrame, width: float = 800.0, height: float = 600.0, margin: float = 60.0) -> DataFrame:
    """Nodes of each workspace on a circle in order of their id, from the top on."""
    placed = numbering.ranked_within(nodes, ["workspace_id"], [F.col("node_id")], "__k", "__n")
    radius = min(width, height) / 2 - margin
    placed = placed.withColumn("angle", 2 * math.pi * (F.col("__k") - 1) / F.col("__n") - math.pi / 2)
    return placed.withColumns({"x": F.cos("angle") * radius + width / 2, "y": F.sin("angle") * radius + height / 2}).drop("__k", "__n")
