"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole. The byte spans of its tokens (the tokens of a byte-level
vocabulary partition the text's UTF-8 bytes) are interval-joined to the sections of the document,
and a token that crosses a border is allocated by an explicit rule:

- ``first``: to the section that holds its first byte;
- ``last``: to the section that holds its last byte;
- ``share``: to each section by its share of the token's bytes.

Sections are lines by default (a line break belongs to the line that it ends), or named fields
that are joined to one text. Counts of a document's sections always add up to its tokens.

Defined results: a null or empty text has no tokens and one empty section, so that it still has
its row; texts of any length are encoded whole; sections without a token count 0; rows are independent, so ties and repeated rows give
equal results; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("first", "last", "share")
#: Pattern of the byte-level vocabulary: fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The library's encoding and the byte length of every token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ends(text: str, path: str) -> np.ndarray:
    """Byte offsets at which the tokens of the whole text end."""
    encoding, lengths = vocabulary(path)
    return np.cumsum(lengths[np.array(encoding.encode_ordinary(text), dtype=np.int64)])


def line_ends(raw: bytes) -> np.ndarray:
    """Byte offsets at which the lines end, each with its line break."""
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(token_end: np.ndarray, section_end: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section, by interval join of two sorted lists of ends.

    ``share`` gives fractions; the other rules whole numbers.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    n = len(section_end)
    if not len(token_end):
        return np.zeros(n, dtype=np.float64 if rule == "share" else np.int64)
    start = np.concatenate(([0], token_end[:-1]))
    if rule == "first":
        return np.bincount(np.searchsorted(section_end, start, side="right"), minlength=n)[:n]
    if rule == "last":
        return np.bincount(np.searchsorted(section_end, token_end - 1, side="right"), minlength=n)[:n]
    # Cut all token spans at the section borders; each piece weighs its part of the token.
    cuts = np.union1d(np.concatenate((start, token_end)), section_end)
    cuts = cuts[cuts <= token_end[-1]]
    left, right = cuts[:-1], cuts[1:]
    token = np.searchsorted(token_end, left, side="right")
    weight = (right - left) / (token_end - start)[token]
    return np.bincount(np.searchsorted(section_end, left, side="right"), weights=weight, minlength=n)[:n]


def section_counts(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first") -> DataFrame:
    """One row per line of every text: id, section, start and end (code points), n_tokens,
    and n_crossing, the tokens that begin in the section and end beyond it."""
    kind = T.DoubleType() if rule == "share" else T.LongType()
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("section", "start", "end")], T.StructField("n_tokens", kind), T.StructField("n_crossing", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, columns = [], [[] for _ in range(5)]
            for text in batch.column("text").to_pylist():
                text = text or ""
                raw = text.encode("utf-8", "replace")
                ends = line_ends(raw)
                tokens = token_ends(text, vocab_path)
                point = ends if len(raw) == len(text) else np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)[ends - 1] if len(raw) else ends
                begin = np.searchsorted(ends, np.concatenate(([0], tokens[:-1])), side="right") if len(tokens) else tokens
                crossing = begin[tokens > ends[begin]] if len(tokens) else begin
                sizes.append(len(ends))
                for held, values in zip(columns, (np.arange(len(ends)), np.concatenate(([0], point[:-1])), point, attribute(tokens, ends, rule), np.bincount(crossing, minlength=len(ends))), strict=True):
                    held.append(values)
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            made = [np.concatenate(c) if c else np.zeros(0) for c in columns]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64() if rule == "share" else pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(a.astype(np.float64 if t == pa.float64() else np.int64), type=t) for a, t in zip(made, types, strict=True)]], names=schema.names)

    return source.mapInArrow(count, schema)


def field_counts(df: DataFrame, fields: list[str], vocab_path: str, rule: str = "first", separator: str = "\n") -> DataFrame:
    """Add ``n_tokens_<field>`` for the named fields of each row, encoded together as one text.

    A separator belongs to the field before it; null fields count as empty; columns of the output's names
    are replaced.
    """
    kind = T.DoubleType() if rule == "share" else T.LongType()

    @F.pandas_udf(T.ArrayType(kind))
    def counts(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns, strict=True):
            parts = [(v or "") + (separator if k + 1 < len(values) else "") for k, v in enumerate(values)]
            ends = np.cumsum([len(p.encode("utf-8", "replace")) for p in parts])
            out.append(attribute(token_ends("".join(parts), vocab_path), ends, rule))
        return pd.Series(out, dtype=object)

    made = df.withColumn("__tessera_counts", counts(*[F.col(f"`{f}`") for f in fields]))
    named = {f"n_tokens_{f}" for f in fields}
    return made.select(*[F.col(f"`{c}`") for c in df.columns if c not in named], *[F.col("__tessera_counts")[k].alias(f"n_tokens_{f}") for k, f in enumerate(fields)])
