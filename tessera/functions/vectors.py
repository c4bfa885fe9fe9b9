"""Vector functions (V1, V2, V4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens

DIMENSIONS = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """V1: cosine; 0 for different lengths, empty or zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


class TokenHasher:
    """V2: a token's digest gives its bucket and sign; a worker remembers ``most`` tokens."""

    def __init__(self, dimensions: int = DIMENSIONS, most: int = 100_000):
        self.dimensions, self.most = dimensions, most
        self.known: dict[str, int] = {}

    def place(self, token: str) -> int:
        """Twice the bucket, one more where the sign is negative."""
        digest = hashlib.sha256(token.encode("utf-8", "replace")).digest()
        return int.from_bytes(digest[:4], "big") % self.dimensions * 2 + (digest[7] & 1)

    def vector(self, tokens: list[str]) -> np.ndarray:
        """Unit vector of the tokens; zero without tokens or where they cancel out."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = self.place(t)
        n = np.bincount([known[t] for t in tokens], minlength=2 * self.dimensions) if len(tokens) else np.zeros(2 * self.dimensions)
        v = (n[::2] - n[1::2]).astype(np.float64)
        length = np.sqrt((v * v).sum())
        return v / length if length else v


def hash_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """V2: hash embedding of each text as a dense array; made in the row, nothing is shuffled."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = TokenHasher(dimensions)
        for lists in batches:
            yield pd.Series([hasher.vector([] if t is None else list(t)) for t in lists], dtype=object)

    return embed(tokens(text))


def hash_embedding(df: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """V2: sparse hash embedding, rows (id, bucket, weight) of length 1; zero buckets are left out."""
    held = df.select(F.col(id_col), F.posexplode(hash_vector(F.col(text_col), dimensions)).alias("bucket", "weight"))
    return held.filter("weight <> 0").select(id_col, F.col("bucket").cast("long").alias("bucket"), "weight")


def embedded_chunks(chunks: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """V3: chunks with words with their vector; an embedding that is missing is an error."""
    held = chunks.filter(F.size(tokens(F.col("text_content"))) > 0).withColumn("embedding", hash_vector(F.col("text_content"), dimensions))
    right = F.coalesce(F.size("embedding") == dimensions, F.lit(False))
    return held.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.lit("an embedding is missing")).cast("array<double>")))


def billions(size: Column) -> Column:
    """V4: ``8B``, ``270M`` and such in billions; null where unreadable."""
    t = F.upper(F.trim(size))
    value = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)[BMK]$", 1).try_cast("double")
    unit = F.right(t, F.lit(1))
    return F.when(unit == "B", value).when(unit == "M", value / 1e3).when(unit == "K", value / 1e6)
