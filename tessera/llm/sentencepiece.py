"""SentencePiece encoding and decoding with a score-ordered agenda (merge-type vocabularies).

The text is cut into units that no piece of the vocabulary can cross. Each distinct unit is
encoded once per worker: its symbols start as characters, all adjacent pairs that form a piece
enter an agenda ordered by (score, position), and the best pair is merged until none is left.
Symbols outside the vocabulary fall back to their UTF-8 bytes. Every newly seen unit is compared
in its Arrow batch with the ``sentencepiece`` library; ``n_differ`` counts units that differed
(the library's ids then stand).

Defined results: a null text counts as empty; an empty text has the end id only and decodes to
the empty string; texts of any length are encoded whole; rows are independent, so ties and repeated rows give equal results; an empty
table gives an empty table; extra columns are kept by :func:`encode` and never read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import entering

SPACE = "▁"
#: Encoded units that a worker keeps in each of two generations; units of the old one that
#: are met again move to the new one, the others go when the new one is full.
CACHE_UNITS = 200_000
#: Units of up to so many characters keep their agenda in a flat list, others in a heap.
SHORT = 40
NEVER = float("inf")
#: Units longer than this are encoded but not kept.
LONGEST_KEPT = 64

RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("n_differ", T.LongType()),
    ]
)


def exact_cut(pieces: list[str]) -> re.Pattern:
    """A pattern for units such that no piece reaches over the border of two of them.

    Units are letters, or anything else, each with the spaces before it. Characters of pieces
    that mix the two kinds go to the second kind until no piece is cut.
    """
    mixed: set[str] = set()
    while True:
        also = re.escape("".join(sorted(mixed)))
        cut = re.compile(rf"{SPACE}*[^\W\d_{also}]+|{SPACE}*(?:[^\w{SPACE}]|[\d_{also}])+|{SPACE}+")
        broken = [p for p in pieces if len(cut.findall(p)) != 1]
        if not broken:
            return cut
        more = {c for p in broken for c in p if c != SPACE} - mixed
        if not more:
            raise ValueError("a piece crosses a word boundary: units would not be exact")
        mixed |= more


class AgendaEncoder:
    """Encoder and decoder over one model file."""

    def __init__(self, model_path: str, cache_units: int = CACHE_UNITS, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib = self.library
        size = lib.vocab_size()
        self.ranks: dict[str, float] = {}  # the lower, the sooner
        self.ids: dict[str, int] = {}
        self.byte_ids = [lib.unk_id()] * 256
        pieces: list[str] = []
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.ids[piece] = i
                if len(piece) > 1:
                    self.ranks[piece] = -lib.get_score(i)
                    pieces.append(piece)
        self.cut = exact_cut(pieces)
        self.names = [str(i) for i in range(size)]
        self.end_id = lib.eos_id()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.cache_units = cache_units
        self.check = check
        self.n_differ = 0

    def merge_short(self, symbols: list[str]) -> list[str]:
        """Merge few symbols; the agenda is a flat list, one entry for each adjacent pair."""
        rank = self.ranks.get
        agenda = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)  # the leftmost of equal scores
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def merge_long(self, symbols: list[str | None]) -> list[str]:
        """The same order of merges by a heap, in n log n steps however long the unit is."""
        n, rank = len(symbols), self.ranks.get
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            r = rank(pair)
            if r is not None:
                agenda.append((r, i, i + 1, pair))
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            # Stale: one of the two symbols has changed since the pair was entered.
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue
            symbols[left], symbols[right] = pair, None
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                wider = pair + symbols[follow]
                if (r := rank(wider)) is not None:
                    heapq.heappush(agenda, (r, left, follow, wider))
            lead = before[left]
            if lead >= 0:
                wider = symbols[lead] + pair
                if (r := rank(wider)) is not None:
                    heapq.heappush(agenda, (r, lead, left, wider))
        return [s for s in symbols if s is not None]

    def merge(self, unit: str) -> tuple[int, ...]:
        """Ids of one unit, by an agenda of adjacent pairs in order of score, then position."""
        symbols = self.merge_short(list(unit)) if len(unit) <= SHORT else self.merge_long(list(unit))
        try:
            return tuple([self.ids[s] for s in symbols])
        except KeyError:
            out: list[int] = []
            for s in symbols:
                if s in self.ids:
                    out.append(self.ids[s])
                else:
                    out.extend(map(self.byte_ids.__getitem__, s.encode("utf-8", "replace")))
            return tuple(out)

    def units(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, units: set[str]) -> dict[str, tuple[int, ...]]:
        """Encode units not yet known, compare them with the library."""
        table = {u: self.old[u] for u in units if u in self.old}
        fresh = [u for u in units if u not in table]
        found = [self.merge(u) for u in fresh]
        if self.check and fresh:
            lead = len(self.library.encode("\n")) if any(u[0] != SPACE for u in fresh) else 0
            theirs = self.library.encode([u[1:] if u[0] == SPACE and len(u) > 1 else u if u[0] == SPACE else "\n" + u for u in fresh], num_threads=1)
            for k, (u, own, other) in enumerate(zip(fresh, found, theirs, strict=True)):
                if u[0] != SPACE:
                    other = other[lead:]
                elif len(u) == 1:
                    continue  # a lone space has no text of its own to compare; merge() gives its id
                if list(own) != other:
                    self.n_differ += 1
                    found[k] = tuple(other)
        table.update(zip(fresh, found, strict=True))
        return table

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text with the end id."""
        if len(self.cache) > self.cache_units:
            self.old, self.cache = self.cache, {}
        units, known = self.units(text or ""), self.cache
        missing = set(units).difference(known)
        if missing:
            known.update(self.learn(missing))
        ids = list(chain.from_iterable(map(known.__getitem__, units)))
        for u in missing:
            if len(u) > LONGEST_KEPT:
                del known[u]
        ids.append(self.end_id)
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder(model_path: str, check: bool = True) -> AgendaEncoder:
    """The worker's encoder; built once per process."""
    return AgendaEncoder(model_path, check=check)


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of every text (end id included) as an array column; one of that name is replaced."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entering("sentencepiece", encoder.cache_clear)
        own = encoder(model_path)
        for texts in batches:
            yield pd.Series([own.encode(t) for t in texts], dtype=object)

    return df.withColumn(ids_col, ids_of(F.col(f"`{text_col}`")))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of every array of ids; a column of that name is replaced."""

    @F.pandas_udf(T.StringType())
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entering("sentencepiece", encoder.cache_clear)
        own = encoder(model_path)
        for ids in batches:
            yield pd.Series([None if x is None else own.decode([int(i) for i in x]) for x in ids], dtype=object)

    return df.withColumn(text_col, text_of(F.col(f"`{ids_col}`")))


def digests(text: Column, model_path: str) -> Column:
    """Struct of the count and digests of a text's ids and of what they decode to.

    The ids stay inside the task: only counts and digests travel on.
    """

    @F.pandas_udf(RESULT)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        entering("sentencepiece", encoder.cache_clear)
        own = encoder(model_path)
        names = own.names
        for texts in batches:
            rows = []
            for t in texts:
                before = own.n_differ
                ids = own.encode(t)
                listed = " ".join([names[i] for i in ids])
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(listed.encode()).hexdigest(),
                        hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest(),
                        own.n_differ - before,
                    )
                )
            yield pd.DataFrame(rows, columns=RESULT.names)

    return digest(text)


def encode_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` with the digest columns, one row per row of ``df``, without a shuffle."""
    return df.select(F.col(f"`{id_col}`"), digests(F.col(f"`{text_col}`"), model_path).alias("d")).select(f"`{id_col}`", "d.*")
