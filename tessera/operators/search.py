"""Retrieval.

Hits are rows (query_id, chunk_id, score). Queries are a small stated set, read in blocks of
``QUERY_BLOCK``: one pass over the chunks serves a block, finds all its terms in a chunk by one
automaton, scores the chunk for all queries by a matrix product, and keeps each query's best within
the task. So neither texts nor pairs of chunk and query are shuffled: what leaves a task is at most
``limit`` rows a query. Texts are joined to the hits that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import rerank_score, search_snippet, tokens
from tessera.functions.vectors import DIMENSIONS, TokenHasher
from tessera.operators import numbering
from tessera.sources import staging

KEYWORD_WEIGHT, VECTOR_WEIGHT = 0.4, 0.6
POOL_FACTOR = 3
DEFAULT_LIMIT = 20
#: Queries that one scan serves; more are served in blocks.
QUERY_BLOCK = 1000
#: Chunks scored at once in a task.
CHUNK_SLICE = 256
#: Scores of vectors and queries (8 bytes each) that a task makes at once: the more queries, the fewer vectors in a slice.
SLICE_SCORES = 1 << 18
#: Rows of hits that may be broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_HITS = 200_000


def vector_hits(rows: DataFrame, queries: DataFrame, limit: int, by: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Rank, query_id, chunk_id, score (six decimals) of the nearest rows (chunk_id, vector) of each query (query_id, qv),
    its own id excepted; with ``by`` only rows of the query's value of that column.

    Each block of queries is a matrix that goes to all tasks; a task multiplies its rows with it in slices and
    keeps each query's best, so no pairs of rows and queries are ever written down. Vectors of another
    length than the query's, empty, zero or with null components have the cosine 0."""
    group = [F.col(by).alias("group")] if by else [F.lit(0).alias("group")]
    own = rows.select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"), *group).filter("chunk_id IS NOT NULL")
    asked = ((r.query_id, r.qv, r.group) for r in queries.select(F.col("query_id").cast("long"), F.col("qv").cast("array<double>").alias("qv"), *group).filter("query_id IS NOT NULL").toLocalIterator())
    out = rows.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    while held := list(islice(asked, block)):
        out = out.union(own.mapInArrow(_nearest(rows.sparkSession.sparkContext.broadcast(VectorBlock(held)), limit), out.schema))
    return ranked(out, ["query_id"], limit)


class VectorBlock:
    """The vectors of a block of queries (id, vector, group): what a task needs to find their nearest rows."""

    def __init__(self, rows: list[tuple[int, list[float] | None, object]]):
        self.ids = np.array([i for i, _, _ in rows], dtype=np.int64)
        self.codes: dict = {}  # groups by number
        self.groups = np.array([self.codes.setdefault(g, len(self.codes)) for _, _, g in rows], dtype=np.int64)
        lengths = np.array([len(v or ()) for _, v, _ in rows])
        #: Length of a vector to the places of the queries that have it, and their unit vectors.
        self.units = {n: (np.flatnonzero(lengths == n), _units(np.array([v for _, v, _ in rows if len(v or ()) == n], dtype=np.float64))) for n in set(lengths.tolist()) if n}

    def scores(self, listed: pa.ListArray) -> np.ndarray:
        """(rows, queries) cosines to six decimals, 0 where there is none."""
        sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy()
        out = np.zeros((len(sizes), len(self.ids)))
        for n, (places, unit) in self.units.items():
            here = np.flatnonzero(sizes == n)
            x = _units(pc.list_flatten(listed.take(pa.array(here))).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(here), n))
            found = x @ unit.T
            out[np.ix_(here, places)] = np.round(found, 6, out=found)
        return out


def _nearest(sent, limit: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        best, size = Best(len(own.ids), limit), max(1, SLICE_SCORES // len(own.ids))
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                chunks, scores = batch.column("chunk_id").to_numpy(), own.scores(batch.column("vector"))
                named = np.array([own.codes.get(g, -1) for g in batch.column("group").to_pylist()], dtype=np.int64)
                scores[(named[:, None] != own.groups[None, :]) | (chunks[:, None] == own.ids[None, :])] = -np.inf
                best.add(scores, chunks)
        q, place = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own.ids[q]), pa.array(best.chunk[q, place]), pa.array(best.score[q, place])], names=["query_id", "chunk_id", "score"])

    return score


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; those that have none become 0."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0.0)


def ranked(hits: DataFrame, by: list[str], limit: int, score: str = "score") -> DataFrame:
    """The best ``limit`` hits of each group, ties by chunk id; tasks cut before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


class QueryBlock:
    """Terms and hash vectors of the queries of a block: what a task needs to score chunks."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.size = np.array([len(t) for _, t in rows], dtype=np.float64)
        self.terms = sorted({t for _, own in rows for t in own})
        at = {t: k for k, t in enumerate(self.terms)}
        self.uses = np.zeros((len(self.terms), len(rows)), dtype=np.float32)  # equal terms count each
        for k, (_, own) in enumerate(rows):
            for t in own:
                self.uses[at[t], k] += 1
        hasher = TokenHasher()
        self.vectors = np.array([hasher.vector(own) for _, own in rows]).reshape(len(rows), DIMENSIONS)

    def keyword(self, lowered: list[str], automaton) -> np.ndarray:
        """(chunks, queries) shares of terms that a chunk contains; not hit: minus infinity."""
        there = np.zeros((len(lowered), len(self.terms)), dtype=np.float32)
        for k, text in enumerate(lowered):
            there[k, list({v for _, v in automaton.iter(text)})] = 1
        found = there @ self.uses
        return np.where(found > 0, found / self.size, -np.inf)

    def vector(self, lowered: list[str], hasher: TokenHasher) -> np.ndarray:
        """(chunks, queries) cosines of hash vectors to six decimals; without a common bucket: minus infinity."""
        x = np.array([hasher.vector(t.split(" ")) for t in lowered]).reshape(len(lowered), DIMENSIONS)
        common = (x != 0).astype(np.float32) @ (self.vectors != 0).astype(np.float32).T
        return np.where(common > 0, np.round(x @ self.vectors.T, 6), -np.inf)


class Best:
    """The best chunks of each query so far, ties by chunk id."""

    def __init__(self, n_queries: int, limit: int):
        self.score = np.full((n_queries, limit), -np.inf)
        self.chunk = np.full((n_queries, limit), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, chunks: np.ndarray) -> None:
        """Take in scores (chunks, queries), minus infinity where there is none. Only those that beat a query's last are sorted."""
        last, limit = self.score[:, -1], self.score.shape[1]
        c, q = np.nonzero(scores >= np.maximum(last, np.finfo(np.float64).min))
        keep = (scores[c, q] > last[q]) | (chunks[c] < self.chunk[q, -1])
        c, q = c[keep], q[keep]
        if not len(q):
            return
        able = np.unique(q)
        query = np.concatenate((q, np.repeat(able, limit)))
        score = np.concatenate((scores[c, q], self.score[able].ravel()))
        chunk = np.concatenate((chunks[c], self.chunk[able].ravel()))
        order = np.lexsort((chunk, -score, query))
        query = query[order]
        starts = np.searchsorted(query, able)
        best = order[(starts[:, None] + np.arange(limit)).ravel()]  # a query has its own ``limit`` places at least
        self.score[able], self.chunk[able] = score[best].reshape(-1, limit), chunk[best].reshape(-1, limit)


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[QueryBlock]:
    """The queries (query_id, query) that have words, block by block."""
    held: list[tuple[int, list[str]]] = []
    for r in queries.select("query_id", tokens(F.coalesce("query", F.lit(""))).alias("terms")).toLocalIterator():
        if r.terms and r.query_id is not None:
            held.append((r.query_id, list(r.terms)))
        if len(held) == block:
            yield QueryBlock(held)
            held = []
    if held:
        yield QueryBlock(held)


def top_hits(chunks: DataFrame, queries: DataFrame, limit: int | None, kinds: tuple[str, ...] = ("keyword",), by: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """kind, query_id, group, chunk_id, score: for each kind of score (``keyword``: F2, ``vector``: V1
    on hash vectors) the best ``limit`` hits of each query and of each value of ``by``, as far as
    tasks can tell; :func:`ranked` merges them. Without a limit all hits of a query."""
    spark = chunks.sparkSession
    group = F.col(by).cast("long") if by else F.lit(0).cast("long")
    rows = chunks.select(F.col("chunk_id").cast("long"), group.alias("group"), F.lower("text_content").alias("low")).filter("chunk_id IS NOT NULL AND low IS NOT NULL")
    schema = T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("query_id", "group", "chunk_id")), T.StructField("score", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    for held in query_blocks(queries, block):
        out = out.union(rows.mapInArrow(_scorer(spark.sparkContext.broadcast(held), limit, kinds), schema))
    return out


def _scorer(sent, limit: int | None, kinds: tuple[str, ...]):
    names = ["kind", "query_id", "group", "chunk_id", "score"]

    def made(kind: str, query: np.ndarray, group: int, chunk: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        n = len(query)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, type=pa.string()), pa.array(query), pa.array([group] * n, type=pa.int64()), pa.array(chunk), pa.array(score)], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        own, hasher = sent.value, TokenHasher()
        automaton = ahocorasick.Automaton()
        for k, t in enumerate(own.terms):
            automaton.add_word(t, k)
        automaton.make_automaton()
        best: dict[tuple[str, int], Best] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_SLICE):
                batch = whole.slice(at, CHUNK_SLICE)
                ids, groups = batch.column("chunk_id").to_numpy(), batch.column("group").fill_null(-1).to_numpy()
                lowered = batch.column("low").to_pylist()
                for kind in kinds:
                    scores = own.keyword(lowered, automaton) if kind == "keyword" else own.vector(lowered, hasher)
                    for g in np.unique(groups):
                        part = np.flatnonzero(groups == g)
                        if limit is None:
                            c, q = np.nonzero(scores[part] > -np.inf)
                            yield made(kind, own.ids[q], int(g), ids[part][c], scores[part][c, q])
                        else:
                            best.setdefault((kind, int(g)), Best(len(own.ids), limit)).add(scores[part], ids[part])
        for (kind, g), b in best.items():
            q, place = np.nonzero(b.score > -np.inf)
            yield made(kind, own.ids[q], g, b.chunk[q, place], b.score[q, place])

    return score


def keyword_hits(chunks: DataFrame, queries: DataFrame, workspace: int | None = None, limit: int | None = None, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """F2: chunks that contain a term of a query, scored by the share of terms (J1 where chunks carry
    their document's workspace), with the chunks' columns; ``limit`` keeps each query's best.

    ``texts`` gives the chunks of stored hits, where it costs less than to make all chunks a second time."""
    if workspace is not None:
        chunks = chunks.filter(F.col("workspace_id") == workspace)
    hits = top_hits(chunks, queries, limit).select("query_id", "chunk_id", "score")
    if limit is not None:
        hits = ranked(hits, ["query_id"], limit).drop("rank")
    if texts is not None:
        hits = staging.stored(hits, "hits")
        chunks = texts(hits)
    return hydrated(hits, chunks, queries, limit).join(queries.select("query_id", "query"), "query_id")


def ranked_hits(chunks: DataFrame, queries: DataFrame, limit: int, kind: str = "keyword", by: str | None = None) -> DataFrame:
    """Rank, query_id, chunk_id, score (and ``by``) of each query's best hits."""
    hits = top_hits(chunks, queries, limit, (kind,), by).drop("kind")
    return ranked(hits, ["query_id", "group"], limit).withColumnRenamed("group", by or "group")


def merged_workspaces(hits: DataFrame) -> DataFrame:
    """The hits of several workspaces in one order for each query: by score, and at equal scores as the
    workspaces and their ranks stand."""
    order = [F.col("score").desc(), F.col("workspace_id"), F.col("rank")]
    return numbering.ranked_within(hits, ["query_id"], order, "place")


def hybrid_hits(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Rank, query_id, chunk_id, score of the best ``POOL_FACTOR * limit`` hits of each query, merged
    from as many of each kind; one pass over the chunks finds both."""
    pool = POOL_FACTOR * limit
    both = ranked(top_hits(chunks, queries, pool, ("keyword", "vector")), ["kind", "query_id"], pool)
    weighted = both.select("query_id", "chunk_id", (F.col("score") * F.when(F.col("kind") == "keyword", KEYWORD_WEIGHT).otherwise(VECTOR_WEIGHT)).alias("score"))
    out = weighted.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return ranked(out, ["query_id"], pool)


def merged(keyword: DataFrame, vector: DataFrame, keyword_weight: float = KEYWORD_WEIGHT, vector_weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Weighted sum of both kinds of hits per query and chunk; a missing side counts 0."""
    both = keyword.select("query_id", "chunk_id", (F.col("score") * keyword_weight).alias("score")).unionByName(vector.select("query_id", "chunk_id", (F.col("score") * vector_weight).alias("score")))
    return both.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))


def hydrated(hits: DataFrame, chunks: DataFrame, queries: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Hits with their chunks' columns; hits without a chunk are dropped.

    Where the number of queries times ``limit`` is small the hits go to the chunks, so no text moves."""
    few = queries is not None and limit is not None and queries.count() * limit <= BROADCAST_HITS
    return chunks.join(F.broadcast(hits) if few else hits, "chunk_id")


def existing(hits: DataFrame, pointers: DataFrame) -> DataFrame:
    """Hits, after their top-k, whose chunk still has a pointer: fewer may be left than asked for."""
    return hits.join(pointers.select("chunk_id").distinct(), "chunk_id", "left_semi")


def reranked(hits: DataFrame, query: Column, limit: int | None = None) -> DataFrame:
    """Term overlap takes the place of the score, which breaks ties only."""
    scored = hits.withColumns({"prior": F.col("score"), "score": rerank_score(F.col("text_content"), query)})
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("prior"), "chunk_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= limit) if limit else out


def decorated(hits: DataFrame, documents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Workspace name (hits of unknown ones are dropped), document path and snippet."""
    named = hits.join(workspaces.select("workspace_id", F.col("display_name").alias("workspace_name")), "workspace_id")
    paths = named.join(documents.select("document_id", "relative_path"), "document_id", "left")
    return paths.withColumns({"relative_path": F.coalesce("relative_path", F.lit("(document not found)")), "snippet": search_snippet(F.col("text_content"))})


def default_limit(settings_value: Column) -> Column:
    """A stored limit, 20 where it is missing or no number."""
    return F.coalesce(settings_value.try_cast("int"), F.lit(DEFAULT_LIMIT))


def research_labels(hits: DataFrame, documents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``workspace / path`` of each distinct document, with fallbacks."""
    docs = hits.select("document_id").distinct().join(documents.select("document_id", "workspace_id", "relative_path"), "document_id", "left")
    named = docs.join(workspaces.select("workspace_id", "display_name"), "workspace_id", "left")
    name = F.coalesce("display_name", F.concat(F.lit("workspace #"), F.col("workspace_id").cast("string")))
    label = F.when(F.col("relative_path").isNull(), F.concat(F.lit("document #"), F.col("document_id").cast("string"))).otherwise(F.concat(name, F.lit(" / "), F.col("relative_path")))
    return named.select("document_id", label.alias("label"))
