"""Approximate nearest neighbours by additive quantisation with exact reranking.

Vectors are scaled by a power of two, so that no product overflows or vanishes and no digit changes,
and to length 1 for the codes. ``STAGES`` codebooks of full-dimensional code words are fitted on a
bounded sample (``max_sample`` rows), each to the residuals of those before it; a vector is
encoded by beam search as the sum of one word of each codebook, and the length of that sum is
stored with the codes. A query builds one lookup table of its products with all code words; a
row's approximate cosine is the sum of ``STAGES`` table entries over the stored length. Rows
are dealt into blocks by a hash; of each block the best ``shortlist`` rows of each query are scored
exactly, in double precision on the original vectors, and the best ``k`` over all blocks are kept.

Queries are dealt into blocks as well, so a task holds one block of rows and one block of queries
whatever the tables' sizes. Every row is indexed and every row is scored for every query of the
stated set: there are no probed cells, so recall depends on the codes alone (on vectors without
cluster structure, as the given ones, cells would have to be probed for the most part).

Defined results: null vectors, vectors of another dimension than most, zero vectors and vectors
with null or non-finite components take no part, neither as query nor as candidate; a query's own
row (its id) is no candidate; ties go to the smaller id, and equal vectors get equal codes, so a
shortlist breaks their ties alike; fewer than ``k`` candidates are all returned; repeated rows of
one id are one row, that of the least usable vector in array order, whatever order the rows come
in; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAGES, WORDS = 16, 256
BEAM = 4
MAX_SAMPLE = 16_384
#: Rows of a block, queries of a block, rows of a block scored exactly for each query.
ROW_BLOCK, QUERY_BLOCK, SHORTLIST = 8_192, 8_192, 256


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return own.filter(F.coalesce(fine, F.lit(False)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5..1: cosines stay as
    they are to the last digit, but no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    # In two steps: one factor alone could overflow.
    half = -exponent // 2
    return np.ldexp(np.ldexp(x, half[:, None]), (-exponent - half)[:, None])


class AdditiveQuantizer:
    """Full-dimensional residual codebooks."""

    def __init__(self, books: np.ndarray):
        self.books = books  # (stages, words, dimensions)
        self.square = (books**2).sum(2)

    @classmethod
    def fit(cls, sample: np.ndarray, stages: int = STAGES, words: int = WORDS, steps: int = 8, seed: int = 7) -> AdditiveQuantizer:
        """Codebooks by k-means on the residuals, stage by stage."""
        rng = np.random.default_rng(seed)
        rest = sample.astype(np.float32).copy()
        books = []
        for _ in range(stages):
            n = min(words, len(rest))
            book = rest[rng.choice(len(rest), n, replace=False)].copy()
            for _ in range(steps):
                near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
                sums = np.zeros_like(book)
                np.add.at(sums, near, rest)
                count = np.bincount(near, minlength=n)
                book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rest[rng.choice(len(rest), n)])
            rest -= book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
            if n < words:
                book = np.concatenate((book, np.zeros((words - n, book.shape[1]), dtype=book.dtype)))
            books.append(book)
        return cls(np.array(books, dtype=np.float32))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, stages) and lengths of the sums, by beam search."""
        codes_out, length_out = [], []
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024].astype(np.float32)
            n = len(part)
            rest, codes = part[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8)
            for book, square in zip(self.books, self.square, strict=True):
                # Error left after each word for each kept path, less what is equal for all words.
                error = (rest**2).sum(2)[:, :, None] + square - 2 * rest @ book.T
                flat = error.reshape(n, -1)
                kept = np.argpartition(flat, min(beam, flat.shape[1] - 1), axis=1)[:, :beam]
                path, word = kept // len(book), kept % len(book)
                rest = np.take_along_axis(rest, path[:, :, None], 1) - book[word]
                codes = np.concatenate((np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype(np.uint8)), axis=2)
            best = (rest**2).sum(2).argmin(1)
            row = np.arange(n)
            codes_out.append(codes[row, best])
            length_out.append(np.linalg.norm(part - rest[row, best], axis=1))
        return np.concatenate(codes_out), np.concatenate(length_out)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, stages * words) products with all code words."""
        return queries.astype(np.float32) @ self.books.reshape(-1, self.books.shape[2]).T


def table_places(codes: np.ndarray) -> np.ndarray:
    """Places of the rows' code words in a query's table."""
    return codes.astype(np.int32) + np.arange(codes.shape[1], dtype=np.int32) * WORDS


def scores(table: np.ndarray, places: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Approximate cosines of one query: a sum of table entries for each row over its length."""
    return table[places].sum(1) / length


def sample_of(vectors: DataFrame, max_sample: int = MAX_SAMPLE) -> np.ndarray:
    """At most ``max_sample`` unit vectors, chosen by a hash of their id; of the commonest size."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max_sample).select("v").toPandas()["v"]
    if not len(rows):
        return np.zeros((0, 0))
    size = int(rows.map(len).mode()[0])
    x = scaled(np.array([r for r in rows if len(r) == size], dtype=np.float64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shortlist: int = SHORTLIST, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows by cosine of each row that ``is_query``
    (a column over vec_id) picks."""
    spark = df.sparkSession
    vectors = usable(df, id_col, vector_col)
    sample = sample_of(vectors, max_sample)
    out = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], out)
    size = sample.shape[1]
    # Tasks combine rows of one id before the shuffle, so an id may hold any share of the rows.
    vectors = vectors.filter(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v"))
    sent = spark.sparkContext.broadcast(AdditiveQuantizer.fit(sample))
    counts = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    row_blocks, query_blocks = -(-counts.n // ROW_BLOCK) or 1, -(-counts.q // QUERY_BLOCK) or 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = scaled(batch.column("v").flatten().to_numpy().reshape(-1, size))
            codes, length = sent.value.encode(x / np.linalg.norm(x, axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in codes], type=pa.binary()), pa.array(length.astype(np.float32))], names=["vec_id", "v", "codes", "length"])

    index = vectors.mapInArrow(encode, "vec_id long, v array<double>, codes binary, length float")
    rows = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = vectors.filter(is_query).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def nearest(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(held) or not len(asked):
            return empty
        held, asked = held.sort_values("vec_id"), asked.sort_values("vec_id")
        ids, x = held["vec_id"].to_numpy(), scaled(np.stack(held["v"].to_numpy()))
        norm = np.sqrt((x * x).sum(1))
        codes = np.frombuffer(b"".join(held["codes"]), dtype=np.uint8).reshape(len(held), -1)
        places = table_places(codes)
        length = np.maximum(held["length"].to_numpy(), 1e-9)
        found = []
        for lo in range(0, len(asked), 256):
            part = asked.iloc[lo : lo + 256]
            q = scaled(np.stack(part["v"].to_numpy()))
            qn = np.sqrt((q * q).sum(1))
            for own, vector, n, table in zip(part["vec_id"], q, qn, sent.value.tables(q / qn[:, None]), strict=True):
                approx = scores(table, places, length)
                approx[ids == own] = -np.inf
                # Rows stand by id and the sort is stable, so equal codes go by id.
                short = np.argsort(-approx, kind="stable")[:shortlist] if len(approx) > shortlist else np.arange(len(approx))
                short = short[ids[short] != own]
                exact = (x[short] * vector).sum(1) / (norm[short] * n)
                best = np.lexsort((ids[short], -exact))[:k]
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids[short][best], "score": exact[best]}))
        return pd.concat(found) if found else empty

    partial = rows.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(nearest, "query_id long, vec_id long, score double")
    # At most k rows of each query and block reach the merge, and k of each task its shuffle.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
