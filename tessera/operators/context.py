"""Context assembly from ranked hits.

``hits`` carry ``by`` columns (one assembly each), rank, chunk_id, document_id, text_content, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import citation_snippet, near_duplicate, normalized, token_count


def exact_dedup(hits: DataFrame, by: list[str]) -> DataFrame:
    """The best-ranked occurrence of each chunk."""
    order = Window.partitionBy(*by, "chunk_id").orderBy("rank")
    return hits.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def near_dedup(hits: DataFrame, by: list[str]) -> DataFrame:
    """hits in rank order without those that nearly repeat a kept one.

    Greedy, hence a fold over the ranked hits of an assembly: they are at most a pool's worth.
    """
    listed = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", normalized(F.col("text_content")).alias("t")))).alias("l"))
    start = F.array().cast("array<struct<rank:int,chunk_id:bigint,t:string>>")
    kept = F.aggregate(F.transform("l", lambda x: F.struct(x["rank"].cast("int").alias("rank"), x["chunk_id"].cast("bigint").alias("chunk_id"), x["t"].alias("t"))), start, lambda acc, x: F.when(F.exists(acc, lambda k: near_duplicate(k["t"], x["t"])), acc).otherwise(F.concat(acc, F.array(x))))
    ids = listed.select(*by, F.explode(F.transform(kept, lambda k: k["rank"])).alias("rank"))
    return hits.join(ids, [*by, "rank"], "left_semi")


def token_budget(hits: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Hits in rank order while their words fit the budget; the first always stays."""
    order = Window.partitionBy(*by).orderBy("rank")
    total = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = hits.withColumn("tokens", token_count(F.col("text_content"))).withColumns({"total_tokens": total, "__n": F.row_number().over(order)})
    return counted.filter((F.col("total_tokens") <= budget) | (F.col("__n") == 1)).drop("__n")


def merge_adjacent(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits of a document with consecutive chunk ids become one, in reading order."""
    order = Window.partitionBy(*by).orderBy("chunk_id")
    fresh = F.when((F.lag("document_id").over(order) == F.col("document_id")) & (F.lag("chunk_id").over(order) == F.col("chunk_id") - 1), 0).otherwise(1)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = hits.withColumn("fresh", fresh).withColumn("island", island)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text_content"))), lambda x: x["text_content"])
    return marked.groupBy(*by, "island").agg(F.min("chunk_id").alias("chunk_id"), F.min("document_id").alias("document_id"), F.array_join(texts, "\n").alias("text_content"), F.max("score").alias("score"), F.count("*").alias("n_merged")).drop("island")


def citations(hits: DataFrame, by: list[str]) -> DataFrame:
    """Numbered citations in reading order."""
    order = Window.partitionBy(*by).orderBy("chunk_id")
    return hits.select(*by, F.row_number().over(order).alias("number"), "chunk_id", "document_id", citation_snippet(F.col("text_content")).alias("snippet"))


def assembled(hits: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Exact and near duplicates out, budget, reading order, neighbours merged."""
    return merge_adjacent(token_budget(near_dedup(exact_dedup(hits, by), by), by, budget), by)
