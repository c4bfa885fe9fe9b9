"""Ranked lexical search by the Best Position Algorithm over impact lists.

The queries are a stated set, read in blocks of ``BLOCK_CHARS`` characters. Documents are read once a
block: each becomes its length and the counts of the block's terms in it, written as a table; the
document frequencies of these terms, N and L are summed up over all rows. Then every task cuts
its rows into blocks of about ``POSTINGS`` postings. In a block each term has a list of (impact,
document), greatest impact first, and every posting can also be found by (document, term).

For a query the lists of its terms are read in parallel. A document met for the first time is looked
up in all lists (direct access), which gives its score and marks its places there as seen. A list's
best position is the end of its seen prefix, whichever access saw it; an unseen document cannot
score more than the sum of the impacts at the best positions. Reading stops when that sum is strictly
below the k-th score that the task has for the query (at equality an unseen document could still
win by its id), or when all lists are read. Tasks give their k best for each query, and a window keeps the k best
of all. No term's list is ever in one place: a word of all documents is shared out with them.

Terms are maximal runs of ASCII letters and digits and of all other characters from U+0080, with only
A-Z lower-cased. Scores are 64-bit integers as the contract of the query states them.

Defined results: null texts and texts without terms take no part and do not count; items without
terms have no rows; ties go by ascending id, null ids last; repeated rows are ranked each, and items
of one id are searched each; texts of any length are whole; an empty table on either side gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import delete, entering, slices, stored, trim

TOP = 10
#: Characters of query text whose terms are counted in one pass over the documents.
BLOCK_CHARS = 4_000_000
#: Postings of a task that are ordered at once.
POSTINGS = 2_000_000
#: Positions read from each list in the first turn and, doubled each turn, at most.
FIRST_DEPTH, LAST_DEPTH = 16, 512

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_blocks(items: Iterable[tuple[object, str | None]], block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, Counter]]]:
    """(item id, counts of its terms) in blocks of a bounded size, one at a time; items without terms are left out."""
    block: list[tuple[object, Counter]] = []
    size = 0
    for item_id, text in items:
        counts = Counter(terms(text))
        if not counts:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, counts))
        size += len(text)
    if block:
        yield block


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, tfs: of each document with terms their number and, packed, numbers and counts of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("tfs", T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("lexical_search")
        known = sent.value
        for batch in slices(batches, 200):
            sizes, numbers, counts = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms(text)
                inside = [known[w] for w in found if w in known]
                t, n = np.unique(np.array(inside, dtype="<i4"), return_counts=True)
                sizes.append(len(found))
                numbers.append(t.tobytes())
                counts.append(n.astype("<i4").tobytes())
            made = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(numbers, type=pa.binary()), pa.array(counts, type=pa.binary())], names=["doc_id", "n", "terms", "tfs"])
            yield made.filter(pc.greater(made.column("n"), 0))
        trim()

    return own.mapInArrow(count, schema)


def statistics(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L, and the document frequencies of the block's terms (as many as the block's terms at most)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            n += batch.num_rows
            total += pc.sum(batch.column("n")).as_py() or 0
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<i4"), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], held)), type=pa.int64()), pa.array(np.concatenate(([n, total], df[held])), type=pa.int64())], names=["term", "v"])

    found = {r.term: r.v for r in counted.select("n", "terms").mapInArrow(sums, "term long, v long").groupBy("term").agg(F.sum("v").alias("v")).collect()}
    df = np.array([found.get(t, 0) for t in range(n_terms)], dtype=np.int64)
    return found.get(-2, 0), found.get(-1, 0), df


class Lists:
    """The impact lists of one block of documents. A document's place follows the order of ids."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, total: int):
        m = 100 - 75 + (75 * lengths * n_docs) // total
        doc = np.repeat(np.arange(len(lengths)), sizes)
        tf = tfs.astype(np.int64)
        impact = weights[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        self.n_docs, self.n_terms = len(lengths), len(weights)
        order = np.lexsort((doc, -impact, numbers))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(numbers[order], np.arange(self.n_terms + 1))
        # Postings come by document and term: the place of each in its list is found by that key.
        self.key = doc * self.n_terms + numbers
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))

    def look_up(self, docs: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Direct access: (documents, terms) places in the lists, -1 where the term is not in the document."""
        wanted = docs[:, None] * self.n_terms + own[None, :]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.place[at], -1)

    def best(self, own: np.ndarray, times: np.ndarray, k: int, least: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """(score, document) of all that can be among the k best of the query and beat or meet ``least``, best
        first and at most k, and how many documents were looked up.

        ``own`` are the query's terms, ``times`` their counts, ``least`` a k-th score known already."""
        keep = self.start[own] < self.start[own + 1]
        own, times = own[keep], times[keep]
        begin, end = self.start[own], self.start[own + 1]
        bp = begin.copy()  # first place of each list not in its seen prefix
        offset = np.concatenate(([0], np.cumsum(end - begin)))
        seen = np.zeros(offset[-1], dtype=bool)
        met = np.zeros(self.n_docs, dtype=bool)
        scores, docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        depth, looked, read = FIRST_DEPTH, 0, begin.copy()
        while len(own):
            fresh = np.unique(np.concatenate([self.doc[a : min(a + depth, e)] for a, e in zip(read, end, strict=True)]))
            fresh = fresh[~met[fresh]]
            read = np.minimum(read + depth, end)
            if len(fresh):
                met[fresh] = True
                looked += len(fresh)
                at = self.look_up(fresh, own)
                there = at >= 0
                score = (np.where(there, self.impact[at], 0) * times).sum(axis=1)
                seen[(at - begin + offset[:-1])[there]] = True
                scores, docs = np.concatenate((scores, score)), np.concatenate((docs, fresh))
                first = np.lexsort((docs, -scores))[:k]
                scores, docs = scores[first], docs[first]
            bound = 0
            for i in range(len(own)):
                part = seen[offset[i] + bp[i] - begin[i] : offset[i + 1]]
                step = int(part.argmin()) if len(part) else 0
                bp[i] += len(part) if len(part) and part[step] else step
                if bp[i] < end[i]:  # a list seen to its end adds nothing to an unseen document
                    bound += int(self.impact[bp[i] - 1] if bp[i] > begin[i] else self.impact[begin[i]]) * int(times[i])
            kth = max(int(scores[k - 1]) if len(scores) >= k else 0, least or 0)
            if bound < kth or bound == 0:
                break
            depth = min(2 * depth, LAST_DEPTH)
        return [(int(s), int(d)) for s, d in zip(scores, docs, strict=True) if s > 0 and s >= (least or 0)], looked


def _ranked(counted: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """query, doc_id, score: each task's k best of each query."""
    sent = counted.sparkSession.sparkContext.broadcast((queries, weights))
    schema = T.StructType([T.StructField("query", T.LongType()), counted.schema["doc_id"], T.StructField("score", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("lexical_search")
        asked, own_weights = sent.value
        best: list[list[tuple[int, bool, object]]] = [[] for _ in asked]  # (-score, id is null, id), best first
        held: list[pa.RecordBatch] = []
        size = 0

        def add() -> None:
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows.column("doc_id"), null_placement="at_end")).combine_chunks()
            ids = rows.column("doc_id")
            packed, tfs = rows.column("terms").to_pylist(), np.frombuffer(b"".join(rows.column("tfs").to_pylist()), dtype="<i4")
            sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            lists = Lists(rows.column("n").to_numpy().astype(np.int64), sizes, np.frombuffer(b"".join(packed), dtype="<i4").astype(np.int64), tfs, own_weights, n_docs, total)
            for q, (own, times) in enumerate(asked):
                found, _ = lists.best(own, times, k, -best[q][k - 1][0] if len(best[q]) >= k else None)
                if found:
                    named = ((-s, i is None, i) for s, i in zip((s for s, _ in found), ids.take(pa.array([d for _, d in found])).to_pylist(), strict=True))
                    best[q] = sorted([*best[q], *named], key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]
            held.clear()

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            at = 0
            sizes = np.cumsum(pc.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False) // 4)
            while at < batch.num_rows:  # as many rows as the block has room for, one at least
                taken = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, taken + POSTINGS - size, side="right")))
                held.append(batch.slice(at, to - at))
                size += int(sizes[to - 1]) - taken
                at = to
                if size >= POSTINGS or at < batch.num_rows:
                    add()
                    size = 0
        if size:
            add()
        if id_type is not None:
            rows = [(q, r[2], -r[0]) for q, found in enumerate(best) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=id_type), pa.array([r[2] for r in rows], type=pa.int64())], names=["query", "doc_id", "score"])
        trim()

    return counted.filter(F.length("terms") > 0).mapInArrow(search, schema)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    out, paths = None, []
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", items.schema[item_id_col].dataType)])
    last = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    asked = ((r[0], r[1]) for r in items.select(F.col(f"`{item_id_col}`"), F.col(f"`{item_text_col}`")).toLocalIterator())
    for block in query_blocks(asked, block_chars):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, c in block for w in c}))}
        counted = stored(term_counts(docs, vocabulary, id_col, text_col), "search-terms", paths)
        n_docs, total, df = statistics(counted, len(vocabulary))
        weights = np.array([weight(int(x), n_docs) for x in df], dtype=np.int64)
        queries = [(np.array([vocabulary[w] for w in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for _, c in block]
        ranked = _ranked(counted, queries, weights, n_docs, total, k).withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(block)], schema)
        found = stored(ids.join(ranked, "query").select("item_id", "rank", "doc_id", "score"), "search-found")
        delete(spark, paths)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", items.schema[item_id_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())]))
    return out
