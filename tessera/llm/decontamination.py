"""Benchmark decontamination with Aho-Corasick automata over normalised questions and answers.

Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. Every
window of ``window`` consecutive item words (the whole item where it has fewer, but not none) is
a pattern `` w1 w2 ... `` of one automaton; each text is normalised once, scanned once, and the
offsets of the hits are mapped back to word numbers and to places in the original text.

Patterns are held by every worker, so their size is checked: items are read one by one and dealt
into blocks of at most ``block_chars`` characters of patterns and ids. Each block is one automaton, sent by
its own broadcast, and every text is scanned once per block; between blocks what was found so far is
written to the shared folder with the rows. Usual benchmarks make one block and no such table;
larger ones cost more scans, never more memory of the driver or a worker.

Defined results: null and wordless texts have no words, no hits and an empty list of items; null
and wordless items have no windows; items whose id is null mark words but are not listed; equal
items and repeated rows count once per id; an empty benchmark leaves all texts clean; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import entering, stored

WINDOW = 10
#: Characters of patterns and ids in one automaton (a worker needs some 40 bytes for each at most).
BLOCK_CHARS = 4_000_000

#: Bytes to bytes: A-Z to a-z, other ASCII but digits and letters to a space; UTF-8 bytes beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_PLACES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("hit_spans", _PLACES),
        T.StructField("word_runs", _PLACES),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def windows(text: str | None, window: int = WINDOW) -> list[str]:
    """Padded patterns of one item."""
    w = [x.decode("utf-8") for x in words(text)]
    if not w:
        return []
    return [f" {' '.join(w[i : i + window])} " for i in range(max(1, len(w) - window + 1))]


def item_blocks(items: Iterable[tuple[object, str | None]], window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[dict[str, list[str]]]:
    """Pattern -> ids of its items, in blocks of a bounded size, one at a time."""
    block: dict[str, list[str]] = {}
    size = 0
    for item_id, text in items:
        for p in windows(text, window):
            # Ids count as well: a window that many items share may go on in the next block.
            listed = [] if item_id is None else [str(item_id)]
            more = (0 if p in block else len(p)) + sum(map(len, listed))
            if block and size + more > block_chars:
                yield block
                block, size, more = {}, 0, len(p) + sum(map(len, listed))
            block.setdefault(p, []).extend(listed)
            size += more
    if block:
        yield block


class Scanner:
    """The automaton of one block of patterns."""

    def __init__(self, block: dict[str, list[str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, ids in block.items():
            self.automaton.add_word(pattern, (len(pattern), pattern.count(" ") - 1, tuple(ids)))
        self.empty = not block
        self.automaton.make_automaton()

    def scan(self, text: str | None, runs: list[tuple[int, int]] | None = None, ids: Iterable[str] = ()) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, marks of the hit words (None: none), ids of the items found, each with
        the runs of words and ids that earlier blocks have found."""
        w, found_ids = words(text), set(ids)
        if not w:
            return 0, None, found_ids
        flat = f" {b' '.join(w).decode('utf-8')} "
        found = [] if self.empty else list(self.automaton.iter(flat))
        if not found and not runs:
            return len(w), None, found_ids
        # Place of the space before each word: its number follows from its offset.
        starts = np.fromiter(accumulate((len(x.decode("utf-8")) + 1 for x in w), initial=0), dtype=np.int64, count=len(w) + 1)
        step = np.zeros(len(w) + 1, dtype=np.int64)
        for begin, end in runs or ():
            step[begin] += 1
            step[end] -= 1
        for end, (length, n, items) in found:
            first = int(np.searchsorted(starts, end - length + 1))
            step[first] += 1
            step[first + n] -= 1
            found_ids.update(items)
        return len(w), np.cumsum(step[:-1]) > 0, found_ids


def word_runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """Runs (begin, end) of marked words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def spans(text: str, marks: np.ndarray) -> list[tuple[int, int]]:
    """Places (code points) in the original text of runs of hit words."""
    raw = text.encode("utf-8", "replace")
    folded = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8)
    inside = np.concatenate(([0], (folded != 32).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(inside))
    begins, ends = edge[::2], edge[1::2]
    point = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return [(int(point[begins[a]]), int(point[ends[b - 1]])) for a, b in word_runs(marks)]


def with_contamination(docs: DataFrame, benchmark: DataFrame, out_col: str = "contamination", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a struct of counts, digest, flag and original places of the hits.

    Texts never move; a column named ``out_col`` is replaced. ``benchmark`` is the stated query set and is read in blocks.
    """
    items = ((r[0], r[1]) for r in benchmark.select(F.col(f"`{item_id_col}`"), F.col(f"`{item_text_col}`")).toLocalIterator())
    blocks = item_blocks(items, window, block_chars)
    block, before = next(blocks, {}), None
    while True:
        following = next(blocks, None)
        column = _scanned(docs, block, F.col(f"`{text_col}`"), before)
        if following is None:
            return docs.withColumn(out_col, column).drop("__tessera_before")
        docs = stored(docs.withColumn("__tessera_before", column), "contamination")
        block, before = following, F.col("__tessera_before")


def _scanned(docs: DataFrame, block: dict[str, list[str]], text: Column, before: Column | None) -> Column:
    """The result of one block on top of that of the blocks before it."""
    key = hashlib.sha256(repr(sorted(block.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def row(own: Scanner, t: str | None, runs=None, ids=()) -> tuple:
        n, marks, found = own.scan(t, runs, ids)
        listed = sorted(found)
        places = [] if marks is None else [{"start": a, "end": b} for a, b in spans(t, marks)]
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        runs = [] if marks is None else [{"start": a, "end": b} for a, b in word_runs(marks)]
        return n, 0 if marks is None else int(marks.sum()), len(found), digest, marks is not None, places, runs, listed

    @F.pandas_udf(RESULT)
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        entering("decontamination", _BUILT.clear)
        own = _shared(key, sent)
        for texts in batches:
            yield pd.DataFrame([row(own, t) for t in texts], columns=RESULT.names)

    @F.pandas_udf(RESULT)
    def later(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        entering("decontamination", _BUILT.clear)
        own = _shared(key, sent)
        for texts, runs, ids in batches:
            yield pd.DataFrame([row(own, t, [(x["start"], x["end"]) for x in r], i) for t, r, i in zip(texts, runs, ids, strict=True)], columns=RESULT.names)

    return first(text) if before is None else later(text, before["word_runs"], before["items"])


_BUILT: dict[str, Scanner] = {}


def _shared(key: str, sent) -> Scanner:
    """The worker's automata, built once for each set of patterns; only the latest set is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(sent.value)
    return _BUILT[key]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs, all columns as they were."""
    found = with_contamination(docs, benchmark, "__tessera_found", **options)
    return found.filter(~F.col("__tessera_found.contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
