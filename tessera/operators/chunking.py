"""Sliding-window chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words

VERSION = "chunker-v1"
LONGEST_WORD = 64


def pieces(w: Column) -> Column:
    """Words; longer ones in pieces of at most 64 bytes, cut between characters.

    Pieces are of 64 characters where all are ASCII and of 16 otherwise (four bytes at most each),
    so no character is lost.
    """
    def cut(w: Column) -> Column:
        n = F.when(F.octet_length(w) == F.length(w), LONGEST_WORD).otherwise(LONGEST_WORD // 4)
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(w) / n).cast("int") - 1), lambda i: F.substring(w, i * n + 1, n))
        return F.when(F.octet_length(w) <= LONGEST_WORD, F.array(w)).otherwise(parts)

    return F.when(F.exists(w, lambda x: F.octet_length(x) > LONGEST_WORD), F.flatten(F.transform(w, cut))).otherwise(w)


def capped(text: Column, limit: int) -> Column:
    """The longest beginning of at most ``limit`` bytes, cut between characters."""
    raw = F.encode(text, "UTF-8")
    # Step back over the bytes that continue a character.
    ends = F.filter(F.sequence(F.lit(limit), F.lit(limit - 3), F.lit(-1)), lambda n: ~F.hex(F.substring(raw, n + 1, F.lit(1))).rlike("^[89AB]"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.get(ends, F.lit(0))), "UTF-8"))


def chunk_blocks(blocks: DataFrame, keys: list[str], window: int = 256, overlap: int = 32, max_bytes: int = 4000, order: str | None = None) -> DataFrame:
    """Chunks of blocks (``keys``, text_content, page_or_location): adds sequence_index, text_content,
    page_or_location_ref, token_count, parser_version.

    ``order`` names the block's place in its document where a document has several blocks; with a
    single block each the sequence index comes from the explode and nothing is shuffled.
    """
    step = max(1, window - overlap)
    last = F.ceil(F.greatest(F.size("w") - window, F.lit(0)) / step).cast("int")
    # The chunks of a block are an array before they are rows, so its words are made once and not copied for each chunk.
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", k * step + 1, F.lit(window)), " ").alias("text"), F.least(F.size("w") - k * step, F.lit(window)).alias("count")))
    held = blocks.withColumn("w", words(F.col("text_content"))).withColumn("w", pieces(F.col("w")))
    rows = held.select(*keys, *([order] if order else []), "page_or_location", F.explode(F.when(F.size("w") > 0, cut)).alias("c"))
    split = rows.select(*keys, *([order] if order else []), "page_or_location", F.col("c.k").alias("k"), F.col("c.text").alias("text"), F.col("c.count").alias("count"))
    index = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "k")) - 1 if order else F.col("k")
    return split.select(
        *keys, index.cast("int").alias("sequence_index"), capped(F.col("text"), max_bytes).alias("text_content"), F.col("page_or_location").alias("page_or_location_ref"),
        F.col("count").cast("int").alias("token_count"), F.lit(VERSION).alias("parser_version"),
    )
