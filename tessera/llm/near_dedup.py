"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are ``shingle`` consecutive words. Their weight is the count in the text times the
normalised inverse document frequency ``1 + ln(N / df) / ln N`` (1 for a shingle of all texts, 2 for
one of a single text), with the true ``df`` of every shingle among the N distinct texts. The idf is
normalised so that the ratio of two weights has the bound 2 at every N: near copies in large
families, whose own words are rarer than what they share, stay near.

Document frequencies are counted by one exchange of packed arrays. Distinct texts are dealt into
blocks of about ``BLOCK`` shingles; each block sends its distinct shingles with their counts, once
each, to ``GROUP``-sized parts of the hash space, which add them up and answer each block. However
common a shingle is, a part sees it once for each block.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each text; two texts agree
on a sample with the probability of their weighted Jaccard similarity. Texts that agree on all
samples of a band share a bucket. Exact copies are one node. Within a bucket every node is verified
by weighted Jaccard similarity against one leader, never against all. What that leaves (nodes that
fail and, since the distance is a metric, members of the leader's group that such a node can reach)
is compared exactly: two texts of similarity t or more share one of the rarest shingles that make up
1 - t of either's weight, so the rest meets by those shingles; groups of one connected class are
done, the others are compared in full, in tasks of a bounded number of shingles (pairs of blocks
where a group is larger). No pair of a bucket is lost at any size. Classes are the connected
components of the verified links.

Defined results: null and empty texts are classes of their own; texts without words are classes of
equal texts; texts of fewer words than a shingle have one shingle; equal texts share a class
whatever their ids; the class id is the smallest document id in it (null where all are null);
repeated rows each get their row; an empty table gives an empty table; extra columns are kept by
:func:`deduplicate` and clash with nothing, since own columns start with ``__tessera_``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import delete, entering, shared_dir, slices, stored, trim, write

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
#: Shingles of a block of texts, and of a part of the hash space.
BLOCK, GROUP = 500_000, 1_000_000
#: Bytes by which a part tells its shingles apart (one in two million counts with another one).
SENT = 5
#: Most texts, and about the most shingles, that one task compares with as many others.
LOCAL, LOCAL_SHINGLES = 1024, 500_000
#: Shingles sampled at once.
SLAB = 1 << 15

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)
    size = min(shingle, len(w))
    h = w[: len(w) - size + 1].copy()
    for i in range(1, size):
        h = h * _M + w[i : len(w) - size + 1 + i]
    return np.unique(_mix(h), return_counts=True)


def weights(counts: np.ndarray, df: np.ndarray, n_texts: int) -> np.ndarray:
    """Counts in a text times the normalised inverse document frequency among ``n_texts`` texts."""
    scale = np.log(n_texts) if n_texts > 1 else 1.0
    return counts * (1 + np.log(n_texts / df) / scale)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    common = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with hashed random numbers.

    For each sample and shingle a hash gives r and c, Gamma(2, 1), and beta, uniform, by tables of
    2**16 quantiles. With weight s: t = floor(ln s / r + beta), ln y = r (t - beta), and the sample is
    the (shingle, t) of least ln c - ln y - r.
    """

    def __init__(self, n_samples: int = BANDS * ROWS):
        # Gamma(2, 1) quantiles: its distribution is 1 - (1 + x) exp(-x), inverted by bisection.
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros_like(p), np.full_like(p, 60.0)
        for _ in range(60):
            middle = (low + high) / 2
            under = 1 - (1 + middle) * np.exp(-middle) < p
            low, high = np.where(under, middle, low), np.where(under, high, middle)
        gamma = (low + high) / 2
        self.r = gamma.astype(np.float32)
        self.inverse_r = (1 / gamma).astype(np.float32)
        self.log_c = np.log(gamma).astype(np.float32)
        self.seeds = _mix(np.arange(1, n_samples + 1, dtype=np.uint64) * _M)

    def samples(self, hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(texts, samples) identities; ``sizes`` are the texts' numbers of shingles, none 0."""
        offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        log_s = np.log(weights).astype(np.float32)
        low16 = np.uint64(0xFFFF)
        out = np.empty((len(sizes), len(self.seeds)), dtype=np.uint64)
        for k, seed in enumerate(self.seeds):
            x = (hashes ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            i = (x & low16).astype(np.int32)
            c = ((x >> np.uint64(16)) & low16).astype(np.int32)
            beta = ((x >> np.uint64(32)) & low16).astype(np.float32) * np.float32(1 / 65536)
            r = self.r[i]
            t = np.floor(log_s * self.inverse_r[i] + beta)
            a = self.log_c[c] - r * (t - beta) - r
            least = np.minimum.reduceat(a, offsets)
            hit = np.flatnonzero(a == np.repeat(least, sizes))
            first = hit[np.searchsorted(hit, offsets)]
            out[:, k] = _mix(hashes[first] + t[first].astype(np.int64).astype(np.uint64) * _M + seed)
        return out

    def bands(self, hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(texts, bands) bucket numbers."""
        s = self.samples(hashes, weights, sizes).reshape(len(sizes), BANDS, ROWS)
        out = np.zeros(s.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            out = _mix(out * _M + s[:, :, i])
        return out


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, first (least id), text: one row for each text that is not empty. Tasks combine copies first."""
    text = F.col(f"`{text_col}`")
    own = docs.select(text_key(text).alias("key"), F.col(f"`{id_col}`").alias("id"), text.alias("text")).filter("key IS NOT NULL")
    return own.groupBy("key").agg(F.min("id").alias("first"), F.first("text").alias("text"))


def packed(texts: DataFrame, n_parts: int, shingle: int = SHINGLE) -> DataFrame:
    """Rows of texts (block, node, key, first, text), and of blocks' shingles (block, part, hashes, counts).

    A block's distinct shingles stand in order of (hash modulo parts, hash); ``SENT`` bytes of the
    quotient go to the part, where about ``GROUP`` shingles must differ."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("node", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("first", texts.schema["first"].dataType), T.StructField("text", T.StringType()),
        T.StructField("part", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("near_dedup")
        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size, block, node = 0, task << 32, task << 32

        def sent() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            order, parts, cuts = _dealt(h, n_parts)
            rest, n = (h[order] // np.uint64(n_parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT], n[order].astype("<u4")
            none, places = pa.nulls(len(parts)), list(zip(cuts, cuts[1:], strict=False))
            columns = [pa.array([block] * len(parts), type=pa.int64()), *[none.cast(arrow.field(i).type) for i in range(1, 5)], pa.array(parts), pa.array([rest[a:b].tobytes() for a, b in places], type=pa.binary()), pa.array([n[a:b].tobytes() for a, b in places], type=pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            none = pa.nulls(n)
            own = [pa.array([block] * n, type=pa.int64()), pa.array(range(node, node + n), type=pa.int64()), batch.column("key").cast(pa.binary()), batch.column("first"), batch.column("text").cast(pa.string())]
            return pa.RecordBatch.from_arrays([*own, none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary())], schema=arrow)

        arrow = None
        for batch in slices(batches, 200):
            if arrow is None:
                first = batch.schema.field("first").type
                arrow = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("key", pa.binary()), ("first", first), ("text", pa.string()), ("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
            begin = 0
            for i, t in enumerate(batch.column("text").to_pylist()):
                h, _ = shingles(t, shingle)
                held.append(h)
                size += len(h)
                if size >= BLOCK:
                    yield rows(batch.slice(begin, i + 1 - begin))
                    yield sent()
                    held.clear()
                    node, begin = node + i + 1 - begin, i + 1
                    size, block = 0, block + 1
            if begin < batch.num_rows:
                yield rows(batch.slice(begin))
                node += batch.num_rows - begin
        if size:
            yield sent()
        trim()

    return texts.mapInArrow(pack, schema)


def _dealt(h: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ascending hashes by (part, hash), the parts that occur, and where each begins and the last ends."""
    part = (h % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    parts, begin = np.unique(part[order], return_index=True)
    return order, parts, np.append(begin, len(part))


def document_frequencies(blocks: DataFrame) -> DataFrame:
    """block, part, df: for the shingles that each block sent to each part, in its order, their counts over all blocks."""

    def count(table: pa.Table) -> pa.Table:
        sizes, values, counts = [], [], []
        for h, n in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True):
            wide = np.zeros((len(h) // SENT, 8), dtype=np.uint8)
            wide[:, :SENT] = np.frombuffer(h, dtype=np.uint8).reshape(-1, SENT)
            values.append(wide.view("<u8").ravel())
            counts.append(np.frombuffer(n, dtype="<u4"))
            sizes.append(len(wide))
        _, at = np.unique(np.concatenate(values), return_inverse=True)
        df = np.bincount(at, weights=np.concatenate(counts))[at].astype("<u4")
        ends = np.cumsum(sizes)
        return pa.table({"block": table.column("block"), "part": table.column("part"), "df": pa.array([df[e - k : e].tobytes() for k, e in zip(sizes, ends, strict=True)], type=pa.binary())})

    return blocks.filter("part IS NOT NULL").select("block", "part", "hashes", "counts").groupBy("part").applyInArrow(count, "block long, part long, df binary")


def signatures(blocks: DataFrame, frequencies: DataFrame, n_texts: int, n_parts: int, shingle: int = SHINGLE) -> DataFrame:
    """node, key, first, size, bands, df: distinct texts with their number of shingles, their buckets (null: no
    words) and the document frequencies of their ascending shingles."""
    texts = blocks.filter("part IS NULL").select("block", "node", "key", "first", "text")
    schema = T.StructType([texts.schema["node"], texts.schema["key"], texts.schema["first"], T.StructField("size", T.IntegerType()), T.StructField("bands", T.BinaryType()), T.StructField("df", T.BinaryType())])

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        entering("near_dedup")
        found = [shingles(t, shingle) for t in left.column("text").to_pylist()]
        bands: list[bytes | None] = [None] * len(found)
        dfs: list[bytes | None] = [None] * len(found)
        own = np.unique(np.concatenate([h for h, _ in found])) if found else np.zeros(0, dtype=np.uint64)
        df = np.zeros(len(own))
        if len(own):
            order, _, _ = _dealt(own, n_parts)
            sent = right.sort_by("part").column("df").to_pylist()
            df[order] = np.frombuffer(b"".join(sent), dtype="<u4")
        sampler = _sampler()
        slab: list[int] = []
        size = 0
        for i, (h, _) in enumerate([*found, (None, None)]):
            if slab and (h is None or size + len(h) > SLAB):
                hashes = np.concatenate([found[k][0] for k in slab])
                own_df = df[np.searchsorted(own, hashes)]
                sizes = np.array([len(found[k][0]) for k in slab])
                made = sampler.bands(hashes, weights(np.concatenate([found[k][1] for k in slab]), own_df, n_texts), sizes)
                ends = np.cumsum(sizes)
                for k, row, n, e in zip(slab, made, sizes, ends, strict=True):
                    bands[k] = row.astype("<u8").tobytes()
                    dfs[k] = own_df[e - n : e].astype("<u4").tobytes()
                slab, size = [], 0
            if h is not None and len(h):
                slab.append(i)
                size += len(h)
        out = pa.table({"node": left.column("node"), "key": left.column("key"), "first": left.column("first"), "size": pa.array([len(h) for h, _ in found], type=pa.int32()), "bands": pa.array(bands, type=pa.binary()), "df": pa.array(dfs, type=pa.binary())})
        trim()
        return out

    return texts.groupBy("block").cogroup(frequencies.groupBy("block")).applyInArrow(sign, schema)


_SAMPLER: list[Sampler] = []


def _sampler() -> Sampler:
    """The worker's sampler: tables of some 800 KB."""
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def text_key(text):
    """Digest by which exact copies are one; null for null and empty texts."""
    return F.when(F.length(text) > 0, F.unhex(F.md5(text)))


def vector(text: str, df: bytes, n_texts: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending shingle hashes of a text and their weights."""
    h, n = shingles(text, shingle)
    return h, weights(n, np.frombuffer(df, dtype="<u4"), n_texts)


def _verified(pairs: DataFrame, texts: DataFrame, n_texts: int, shingle: int) -> DataFrame:
    """(a, b) with their weighted Jaccard similarity; texts are joined on both sides by node."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("df").alias("df_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("df").alias("df_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "df_a", "text_b", "df_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("near_dedup")
        last, other = None, None
        for batch in slices(batches, 200):
            out = []
            for _, b, ta, da, tb, db in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if b != last:  # rows of one leader come together
                    last, other = b, vector(tb, db, n_texts, shingle)
                out.append(similarity(vector(ta, da, n_texts, shingle), other))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, type=pa.float64())], names=["a", "b", "sim"])
        trim()

    return joined.mapInArrow(verify, "a long, b long, sim double")


def _upper_bounds(vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For all pairs of a small set a number that their similarity cannot exceed.

    A minimum is at most the geometric mean, so products of square roots of weights bound what two
    texts have in common. Shingles of one text alone add nothing; the others go in blocks.
    """
    total = np.array([v[1].sum() for v in vectors])
    flat = np.concatenate([v[0] for v in vectors])
    root = np.sqrt(np.concatenate([v[1] for v in vectors])).astype(np.float32)
    who = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    who, column, root = who[keep], place[column[keep]], root[keep]
    order = np.argsort(column, kind="stable")
    who, column, root = who[order], column[order], root[order]
    common = np.zeros((len(vectors), len(vectors)), dtype=np.float32)
    for lo in range(0, int(shared.sum()), 1024):
        part = slice(*np.searchsorted(column, [lo, lo + 1024]))
        block = np.zeros((len(vectors), 1024), dtype=np.float32)
        block[who[part], column[part] - lo] = root[part]
        common += block @ block.T
    for i, row in enumerate(common):  # in place: a set of this size fills one matrix, not four
        row /= np.maximum(total[i] + total - row, 1e-9)
    return common


def _leaders(rows: DataFrame) -> DataFrame:
    """bucket, b: the leader of each bucket is the node that stands in the fullest buckets.

    In a family of near copies that is its most central text, and all its bands agree on it.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    central = rows.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("weight"))
    place = F.struct(F.col("weight"), F.xxhash64("node"))
    return rows.join(central, "node").groupBy("bucket").agg(F.max_by("node", place).alias("b"))


def rare_shingles(texts: DataFrame, n_texts: int, least: float, shingle: int) -> DataFrame:
    """node, h: of each text the rarest shingles (by document frequency, then hash) that two texts of
    similarity ``least`` must have in common: those before which ``least`` of the weight is left.
    Shingles of one text alone are left out."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("near_dedup")
        for batch in slices(batches, 200):
            nodes, found = [], []
            for node, text, df in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), batch.column("df").to_pylist(), strict=True):
                h, w = vector(text, df, n_texts, shingle)
                d = np.frombuffer(df, dtype="<u4")
                order = np.lexsort((h, d))
                before = np.cumsum(w[order]) - w[order]
                total = w.sum()
                kept = order[total - before >= least * total * (1 - 1e-9)]
                kept = kept[d[kept] > 1]
                nodes.append(np.full(len(kept), node, dtype=np.int64))
                found.append(h[kept])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(found).view(np.int64))], names=["node", "h"])

    return texts.select("node", "text", "df").mapInArrow(choose, "node long, h long")


def _tasks(rows: DataFrame) -> DataFrame:
    """Rows (h, node, size, label) with the task (h, p, q) that each goes to.

    Of groups with equal members one is kept, of groups with one label none. A group of several
    blocks is compared in pairs of blocks.
    """
    groups = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("y")).filter("low < high")
    one = groups.groupBy("x", "y", "n").agg(F.min("h").alias("h"), F.max("total").alias("total"))
    parts = F.greatest(F.ceil(F.col("n") / LOCAL), F.ceil(F.col("total") / LOCAL_SHINGLES)).cast("int")
    held = rows.join(one.select("h", parts.alias("parts")), "h").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("h", "node", "label", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))


def _local_links(rows: DataFrame, texts: DataFrame, n_texts: int, least: float, shingle: int) -> DataFrame:
    """Links between the nodes of each task (h, p, q).

    Pairs already connected are skipped and so are those that an upper bound rules out, but no other.
    """

    def compare(table: pa.Table) -> pa.Table:
        held = sorted(zip(*[table.column(c).to_pylist() for c in ("node", "label", "text", "df")], strict=True), key=lambda r: r[0])
        nodes = [r[0] for r in held]
        vectors = [vector(r[2], r[3], n_texts, shingle) for r in held]
        possible = _upper_bounds(vectors) >= least - 1e-3
        group = np.array([r[1] for r in held], dtype=np.int64)  # members of a class are connected from the start
        a, b = [], []
        for j in range(1, len(nodes)):
            for i in np.flatnonzero(possible[j, :j]):
                if group[i] != group[j] and similarity(vectors[i], vectors[j]) >= least:
                    a.append(nodes[j])
                    b.append(nodes[i])
                    group[group == group[j]] = group[i]
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    joined = rows.join(texts.select("node", "text", "df"), "node").select("h", "p", "q", "node", "label", "text", "df")
    return joined.groupBy("h", "p", "q").applyInArrow(compare, "a long, b long").distinct()


def links(texts: DataFrame, nodes: DataFrame, n_texts: int, least: float = SIMILARITY, shingle: int = SHINGLE, paths: list[str] | None = None) -> DataFrame:
    """Verified links (a, b) that connect all nodes of similarity ``least`` or more that share a bucket.

    ``texts``: node, text; ``nodes``: node, size, bands, df."""
    paths = [] if paths is None else paths
    numbers = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.conv(F.hex(F.substring("bands", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    banded = nodes.filter("bands IS NOT NULL").select("node", F.explode(numbers).alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket")
    rows = stored(banded.join(crowded, "bucket").select("bucket", "node"), "dedup-rows", paths)
    own = rows.select("node").distinct().join(nodes.select("node", "size", "df"), "node")
    texts = stored(texts.join(own, "node").select("node", "size", "df", "text"), "dedup-texts", paths)
    led = stored(rows.join(_leaders(rows), "bucket").filter("node <> b").select("bucket", F.col("node").alias("a"), "b"), "dedup-led", paths)
    checked = stored(_verified(led.select("a", "b").distinct(), texts, n_texts, shingle), "dedup-checked", paths)
    near = stored(checked.filter(F.col("sim") >= least).select("a", "b"), "dedup-near", paths)
    # What the leaders leave: nodes that fail, and members that such a node can reach.
    joined = led.join(checked, ["a", "b"])
    marks = joined.filter(F.col("sim") < least).groupBy("bucket").agg(F.min("sim").alias("low"), F.max("sim").alias("top"))
    sim, room = F.col("sim"), 1 - least + 1e-9
    left = joined.join(marks, "bucket").filter((sim < least) | sim.between(F.col("low") - room, F.col("top") + room))
    rest = stored(left.select(F.col("a").alias("node")).distinct(), "dedup-rest", paths)
    if rest.isEmpty():
        return near
    labels = components(near, paths)
    rest = rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rare = rare_shingles(texts.join(rest.select("node"), "node"), n_texts, least, shingle)
    met = stored(rare.join(rest, "node").join(texts.select("node", "size"), "node"), "dedup-met", paths)
    return near.union(stored(_local_links(_tasks(met), texts, n_texts, least, shingle), "dedup-local", paths))


def components(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """node, label (least node of its component) of all nodes of ``edges`` (a, b).

    Each round takes the least label among the neighbours, then the label's own label; rounds
    are written to the shared folder, so lineage stays short.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "components-edges", paths)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "components-start", paths)
    turn = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        over = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        fresh = stored(step.join(over, "new").select("node", "label", F.least("new", "far").alias("new")), f"components{turn}", paths)
        turn += 1
        done = fresh.filter("new <> label").isEmpty()
        labels = fresh.select("node", F.col("new").alias("label"))
        if done:
            return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float, shingle: int) -> DataFrame:
    """key, class_id, stays, first of the distinct texts, as a stored table."""
    spark, paths = docs.sparkSession, []
    text = F.col(f"`{text_col}`")
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    n_parts = max(1, size // (6 * GROUP))  # some six bytes a word
    try:
        # Texts and blocks' shingles are made in one pass and kept apart: the shingles go once they are counted.
        made = packed(distinct_texts(docs, id_col, text_col), n_parts, shingle)
        path = f"{shared_dir(spark)}/dedup-blocks-{uuid.uuid4().hex}"
        paths.append(path)
        write(made.withColumn("kind", F.when(F.col("part").isNull(), "texts").otherwise("shingles")), path, "kind")
        # A table without rows has no folders: the whole is read, and pruned to one folder by its kind.
        blocks = spark.read.schema(T.StructType([*made.schema, T.StructField("kind", T.StringType())])).parquet(path)
        texts = blocks.filter("kind = 'texts'").drop("kind")
        n_texts = texts.count()
        frequencies = stored(document_frequencies(blocks.filter("kind = 'shingles'")), "dedup-df", paths)
        delete(spark, [f"{path}/kind=shingles"])
        texts = spark.read.schema(T.StructType([*made.schema, T.StructField("kind", T.StringType())])).parquet(path).drop("kind")
        nodes = stored(signatures(texts, frequencies, n_texts, n_parts, shingle), "dedup-nodes", paths)
        texts = texts.select("node", "text")
        labels = components(stored(links(texts, nodes, n_texts, least, shingle, paths), "dedup-links", paths), paths)
        labelled = nodes.select("node", "key", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        last = F.lit(2**63 - 1)
        heads = labelled.groupBy("label").agg(F.min("first").alias("class_id"), F.min_by("node", F.coalesce("first", last)).alias("head"))
        return stored(labelled.join(heads, "label").select("key", "class_id", (F.col("node") == F.col("head")).alias("stays"), "first"), "dedup-classes")
    finally:
        delete(spark, paths)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and class_id, one row for each row of ``docs``."""
    classes = _classes(docs, id_col, text_col, least, shingle)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_key(F.col(f"`{text_col}`")).alias("key"))
    return own.join(classes.select("key", "class_id"), "key", "left").select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each class (that of its smallest id), all columns as they were."""
    classes = _classes(docs, id_col, text_col, least, shingle)
    heads = classes.filter("stays").select(F.col("key").alias("__tessera_key"), F.col("first").alias("__tessera_first"))
    own = docs.withColumn("__tessera_key", text_key(F.col(f"`{text_col}`")))
    kept = own.join(heads, "__tessera_key").filter(F.col(f"`{id_col}`").eqNullSafe(F.col("__tessera_first")))
    kept = kept.dropDuplicates(["__tessera_key"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return own.filter("__tessera_key IS NULL").select(*columns).union(kept.select(*columns))
