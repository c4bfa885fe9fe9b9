"""Token-id files of patched frame-of-reference blocks.

A file set is a folder of shards in ascending order of document id, written by Spark's committed
Parquet writer, one row per document: (shard, doc_id, local_start, n_tokens, payload). A payload is

    magic "PFR1" | u32 ids | u32 blocks | u32 start of each block in the payload | blocks

and a block of up to 128 ids is

    u32 minimum | u8 width | u8 exceptions | 16 bytes for each of width bit planes of the
    differences | u8 place of each exception | u32 difference of each exception

where the width holds all differences up to a percentile of the block and the others are
exceptions. Block starts are indexed, so any range of ids is read without decoding the rest.

Documents are dealt by ranges of their id before they are encoded, so texts move once and ids
never do. The place of a document in the whole id sequence is its place in the shard plus the ids
of the shards before it (one number per shard).

Defined results: null and empty texts hold the end id only; texts of any length are whole; null document ids come first; rows of
one id lie in the order of their texts; repeated rows are kept; an empty table gives an empty
file set; extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices

MAGIC = b"PFR1"
BLOCK = 128
#: Share of a block's differences that its width must hold.
PERCENTILE = 0.9
#: Pre-tokens and chunks whose ids a worker keeps in each of two generations.
CACHE_CHUNKS = 400_000
LONGEST_KEPT = 64
#: Blocks packed or unpacked at once.
SLAB = 2048


#: Bytes as the characters that byte-level vocabularies write them with: printable Latin-1 bytes
#: stand for themselves, the others follow each other from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_SPELT = BYTE_CHARS | {32: 32}  # words with spaces between them

#: Latin-1 letters, and ASCII signs that are neither letters nor digits.
_LETTERS, _SIGNS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
#: A word and the signs behind it are one pre-token each.
_WORD_AND_SIGNS = f"^(?P<word>[{_LETTERS}]+)(?P<signs>[{_SIGNS}]*)$"
_LOWER_WORD = re.compile("[a-zªµºß-öø-ÿ]+").fullmatch
#: Words that the library encodes as one text.
WORDS_AT_ONCE = 64


class KnownChunks(dict):
    """Chunk -> its ids; a chunk not held is encoded by the library and kept.

    Latin-1 letters are lower-cased one by one and have no other normal form, so a lower-case
    Latin-1 word is one pre-token, which the library's model encodes directly.
    """

    def __init__(self, library):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library, self.old = library, {}
        self.pre_tokens = Tokenizer(library.model)
        self.pre_tokens.pre_tokenizer = WhitespaceSplit()
        vocabulary, suffix = library.get_vocab(), getattr(library.model, "end_of_word_suffix", None)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.is_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def turn(self) -> None:
        """Start a new generation; of those before, the last one is still read."""
        self.old = dict(self)
        self.clear()

    def find(self, chunks: pa.Array) -> pa.Array:
        """The ids of different chunks, as binary values."""
        keys = chunks.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, keys))
        words = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            chunk = keys[i]
            found[i] = ids = self.old.get(chunk)
            if ids is not None:
                self.keep(chunk, ids)
            elif _LOWER_WORD(chunk):
                words.append(i)
            else:
                found[i] = self.keep(chunk, self.whole(chunk))
        for i, ids in zip(words, self.words([keys[i] for i in words]), strict=True):
            found[i] = self.keep(keys[i], ids)
        return pa.array(found, pa.large_binary())

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= LONGEST_KEPT and len(self) <= CACHE_CHUNKS:
            self[chunk] = ids
        return ids

    def words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of lower-case Latin-1 words, told apart by the tokens that end a word."""
        for lo in range(0, len(words), WORDS_AT_ONCE):
            part = words[lo : lo + WORDS_AT_ONCE]
            ids = np.array(self._pre_tokens(" ".join(part)), dtype="<u4")
            ends = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                yield from [data[x:y] for x, y in itertools.pairwise([0, *ends])]
            else:  # a vocabulary that does not mark them
                yield from [np.array(self._pre_tokens(w), dtype="<u4").tobytes() for w in part]

    def _pre_tokens(self, text: str) -> list[int]:
        return self.pre_tokens.encode_batch_fast([text.encode().decode("latin-1").translate(_SPELT)], add_special_tokens=False)[0].ids

    def whole(self, chunk: str) -> bytes:
        ids = self.library.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class ChunkEncoder:
    """Ids by the tokenizers library; chunks between white space are encoded once and kept.

    The vocabulary drops white space and its pre-tokenizer splits at it, so the ids of a text are
    those of its chunks in order. Texts are cut at ASCII white space (other white space stays in
    its chunk), each different chunk of a run of texts once into its word and the signs behind it.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        two = self.library.encode("a b", add_special_tokens=False).ids
        # Where the vocabulary keeps one of them, texts are cut at spaces alone.
        dropped = all(self.library.encode(f"a{c}b", add_special_tokens=False).ids == two for c in "\t\n\v\f\r")
        self.split = pc.ascii_split_whitespace if dropped else partial(pc.split_pattern, pattern=" ")
        self.end = struct.pack("<I", end_id)
        self.known = KnownChunks(self.library)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids with the end id."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; some ten times the bytes of the texts are held."""
        if len(self.known) > CACHE_CHUNKS:
            self.known.turn()
        cut = self.split(texts.fill_null(""))
        chunks = cut.values.dictionary_encode()
        parts = pc.extract_regex(chunks.dictionary, _WORD_AND_SIGNS)
        words = pc.coalesce(pc.utf8_lower(pc.struct_field(parts, 0)), chunks.dictionary).dictionary_encode()
        signs = pc.struct_field(parts, 1).fill_null("").dictionary_encode()
        halves = [self.known.find(x.dictionary).take(x.indices) for x in (words, signs)]
        ids = pc.binary_join_element_wise(*halves, pa.scalar(b"", pa.large_binary())).take(chunks.indices)
        _, places, data = ids.buffers()
        bounds = np.frombuffer(places, dtype=np.int64)[cut.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        view = memoryview(data or b"")
        return [b"".join((view[lo:hi], self.end)) for lo, hi in itertools.pairwise(bounds)]


@lru_cache(maxsize=2)
def chunk_encoder(path: str, end_id: int) -> ChunkEncoder:
    return ChunkEncoder(path, end_id)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.searchsorted(2 ** np.arange(33, dtype=np.uint64), values, side="right")


def pack_blocks(rows: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Encode blocks, the rows of an (n, 128) array of unsigned 32-bit ids."""
    out: list[bytes] = [b""] * len(rows)
    for lo in range(0, len(rows), SLAB):
        part = rows[lo : lo + SLAB]
        least = part.min(axis=1)
        diff = part - least[:, None]
        kth = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
        width = _bits(np.partition(diff, kth, axis=1)[:, kth].astype(np.uint64))
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            d = diff[own]
            outlier = (d >> np.uint32(w)) > 0 if w < 32 else np.zeros(d.shape, dtype=bool)
            low = np.where(outlier, np.uint32(0), d)
            packed = np.empty((len(own), 16 * w), dtype=np.uint8)
            for bit in range(w):
                packed[:, 16 * bit : 16 * bit + 16] = np.packbits((low & np.uint32(1 << bit)) != 0, axis=1)
            row, place = np.nonzero(outlier)
            counts = np.bincount(row, minlength=len(own))
            last = np.cumsum(counts)
            places, values = place.astype(np.uint8).tobytes(), d[row, place].astype("<u4").tobytes()
            heads = zip(own.tolist(), least[own].tolist(), counts.tolist(), last.tolist(), packed, strict=True)
            for i, low_value, n, end, body in heads:
                out[lo + i] = b"".join((struct.pack("<IBB", low_value, w, n), body.tobytes(), places[end - n : end], values[4 * (end - n) : 4 * end]))
    return out


def unpack_blocks(blocks: list[bytes]) -> np.ndarray:
    """The (n, 128) array of ids of encoded blocks."""
    out = np.zeros((len(blocks), BLOCK), dtype=np.uint32)
    for lo in range(0, len(blocks), SLAB):
        part = blocks[lo : lo + SLAB]
        heads = [struct.unpack_from("<IBB", b) for b in part]
        width = np.array([h[1] for h in heads])
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            if w:
                raw = np.frombuffer(b"".join([part[i][6 : 6 + 16 * w] for i in own]), dtype=np.uint8).reshape(len(own), w, 16)
                diff = np.zeros((len(own), BLOCK), dtype=np.uint32)
                for bit in range(w):
                    diff |= np.unpackbits(raw[:, bit], axis=1).astype(np.uint32) << np.uint32(bit)
            else:
                diff = np.zeros((len(own), BLOCK), dtype=np.uint32)
            tails = [(heads[i][2], part[i][6 + 16 * w :]) for i in own]
            counts = np.array([n for n, _ in tails])
            if counts.any():
                row = np.repeat(np.arange(len(own)), counts)
                places = np.frombuffer(b"".join([t[:n] for n, t in tails]), dtype=np.uint8)
                diff[row, places] = np.frombuffer(b"".join([t[n : 5 * n] for n, t in tails]), dtype="<u4")
            out[lo + own] = diff + np.array([heads[i][0] for i in own], dtype=np.uint32)[:, None]
    return out


def pack_documents(documents: list[bytes], percentile: float = PERCENTILE) -> list[bytes]:
    """Payloads of documents given as little-endian ids; all their blocks are packed together."""
    sizes = [len(d) // 4 for d in documents]
    n_blocks = [-(-n // BLOCK) for n in sizes]
    padded = []
    for d, n, b in zip(documents, sizes, n_blocks, strict=True):
        padded.append(d)
        if n % BLOCK:  # the last id again, which never widens a block
            padded.append(d[-4:] * (b * BLOCK - n))
    blocks = pack_blocks(np.frombuffer(b"".join(padded), dtype="<u4").reshape(-1, BLOCK), percentile)
    out, at = [], 0
    for n, b in zip(sizes, n_blocks, strict=True):
        own = blocks[at : at + b]
        at += b
        first = 12 + 4 * b
        starts = first + np.cumsum([0, *map(len, own[:-1])]) if b else np.zeros(0)
        out.append(MAGIC + struct.pack("<II", n, b) + starts.astype("<u4").tobytes() + b"".join(own))
    return out


def _open(payload: bytes) -> tuple[int, list[bytes]]:
    if payload[:4] != MAGIC:
        raise ValueError("not a token payload")
    n, b = struct.unpack_from("<II", payload, 4)
    starts = [*struct.unpack_from(f"<{b}I", payload, 12), len(payload)]
    return n, [payload[x:y] for x, y in zip(starts[:-1], starts[1:], strict=True)]


def unpack_documents(payloads: list[bytes]) -> list[np.ndarray]:
    """Ids of payloads; all their blocks are unpacked together."""
    opened = [_open(p) for p in payloads]
    rows, at, out = unpack_blocks([b for _, own in opened for b in own]), 0, []
    for n, own in opened:
        out.append(rows[at : at + len(own)].reshape(-1)[:n])
        at += len(own)
    return out


def read_range(payload: bytes, begin: int, end: int) -> np.ndarray:
    """Ids begin..end of a payload, decoding only the blocks that hold them."""
    n, b = struct.unpack_from("<II", payload, 4)
    begin, end = max(0, begin), min(end, n)
    if begin >= end:
        return np.zeros(0, dtype=np.uint32)
    first, last = begin // BLOCK, (end - 1) // BLOCK
    starts = [*struct.unpack_from(f"<{b}I", payload, 12), len(payload)]
    rows = unpack_blocks([payload[starts[i] : starts[i + 1]] for i in range(first, last + 1)])
    return rows.reshape(-1)[begin - first * BLOCK : end - first * BLOCK]


def _pieces(sizes: Iterable[int], limit: int = 1 << 22) -> Iterator[slice]:
    """Runs of documents of a bounded size together."""
    lo = hi = held = 0
    for n in sizes:
        if held and held + n > limit:
            yield slice(lo, hi)
            lo, held = hi, 0
        held += n
        hi += 1
    if lo < hi:
        yield slice(lo, hi)


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", percentile: float = PERCENTILE) -> None:
    """Encode every text and write the file set to ``path``, a folder that all executors share."""
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = source.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard, start = chunk_encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for run in _pieces(pc.binary_length(texts).fill_null(0).to_pylist()):
                part = own.encode_all(texts[run])
                sizes = np.array([len(d) // 4 for d in part], dtype=np.int64)
                begins = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), shard, dtype=np.int32)), batch.column("doc_id")[run], pa.array(begins), pa.array(sizes), pa.array(pack_documents(part, percentile), type=pa.binary())],
                    names=schema.names,
                )

    ordered.mapInArrow(write, schema).write.parquet(path)


#: Most shards whose sums are broadcast.
MAX_BROADCAST = 100_000


def _with_start(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the file set with the global place of each document."""
    held = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard, whatever the documents: the window stays small, and the sums are broadcast
    # where their checked number allows it.
    base = held.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    few = held.select("shard").distinct().count() <= MAX_BROADCAST
    return held.join(F.broadcast(base) if few else base, "shard").withColumn("start", F.col("base") + F.col("local_start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document of a file set."""
    rows = _with_start(spark, path).select("doc_id", "start", "n_tokens", "payload")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("ids", T.ArrayType(T.LongType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = unpack_documents(batch.column("payload").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in schema.names[:3]], pa.array([x.astype(np.int64) for x in ids], type=pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(read, schema)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids read back from a file set."""
    rows = _with_start(spark, path).select("doc_id", "start", "payload")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = []
            payloads = batch.column("payload").to_pylist()
            for run in _pieces(map(len, payloads)):
                ids += unpack_documents(payloads[run])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array([len(x) for x in ids], type=pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], type=pa.int64())],
                names=schema.names,
            )

    return rows.mapInArrow(read, schema)
