"""Removal of long repeated byte strings by difference-cover suffix sorting, one suffix bucket at a time.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else, in the same text
or another. Equal strings are neighbours in the order of suffixes, so the order tells them all.

Suffixes are dealt to tasks by content: a window (the first ``WINDOW`` bytes of a suffix) goes by its
least 64-gram under a hash, its mark. Equal windows have equal marks, and consecutive windows
mostly share one, so a run of windows travels as one piece of text, not as suffixes. First each
block of texts sends its marks with the number of their places, packed; their totals come back. A mark
of one place has no partner, and its run stays where it is. A mark of more than ``HEAVY`` places (a line
that very many texts hold) would fill one task; its windows are dealt by their least 180-gram,
which few of these share. Then the runs that are left are sent, equal pieces of a block once.

In a task (:class:`Suffixes`) the pieces stand in one string. Positions whose residue modulo 31 lies in
a difference cover of six are ranked first, by their first 31 bytes and then by doubling (62, 124, 248
bytes). The windows are split by leading bytes into buckets of about ``BUCKET``; one bucket at a time is
sorted by its first 31 bytes, and ties that last longer are resolved by the cover ranks: for any two
residues there is a shift below 31 that takes both into the cover. So memory is the string, the
ranks of a fifth of its positions, and one bucket. Neighbours that agree in all ``WINDOW`` bytes are
repeats; pieces that came several times count so often.

Defined results: null and empty texts, and those under ``WINDOW`` bytes, lose nothing; overlapping
repeats count, and strings are judged on the input; repeated rows are texts of their own, so a copy of a
text of ``WINDOW`` bytes or more goes whole, both times; texts of any length are whole and cut into slabs;
what is left of a text is bytes, since a cut can fall inside a character; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import delete, entering, shared_dir, slices, stored, trim, write

WINDOW = 200
#: Bytes of text of a block, and windows of one text that are marked at once.
BLOCK, SLAB = 4_000_000, 1 << 20
#: Windows of one piece at most.
PIECE = 1024
#: Marks that a part adds up; bytes of pieces that a task sorts; places from which a mark is heavy.
GROUP, PART, HEAVY = 2_000_000, 4_000_000, 20_000
#: Suffixes sorted at once.
BUCKET = 1_000_000

#: A difference cover modulo 31: every residue is a difference of two of its members.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)



def gram(window: int) -> int:
    """Bytes of the strings among which a window's mark is sought: 64 for windows of 200."""
    return window * 8 // 25


def long_gram(window: int) -> int:
    """The same for windows of a heavy mark: 180 for windows of 200."""
    return window * 9 // 10


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of ``size`` bytes, by doubling."""
    h, have = _mix((raw.astype(np.uint64) + np.uint64(1)) * _B), 1
    while have < size:
        step = min(have, size - have)
        left = h[:-step] * _B
        left ^= left >> np.uint64(29)
        left += h[step:]
        h = left
        have += step
    return _mix(h)


def least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def runs(raw: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """begin, length, mark, places: runs of consecutive windows of one mark, and at how many places the mark stands
    in the run (windows of a periodic text can be equal within it).

    The place is kept in the low bits while the least is sought, so a mark has the 43 bits above them."""
    if len(raw) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none
    h = grams(raw, size)
    low = np.uint64((1 << 21) - 1)
    first = least((h & ~low) | np.arange(len(h), dtype=np.uint64), window - size + 1)
    place = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    mark = first[place] & ~low
    new = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
    begin = place[new]
    return begin, np.diff(np.append(begin, len(first))), mark[new], np.diff(np.append(new, len(place)))


def slabs(raw: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) such that each window of a text begins in one slab and lies in it."""
    for at in range(0, max(1, len(raw) - window + 1), SLAB):
        yield at, raw[at : at + SLAB + window - 1]


def _dealt(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by part (stable), the parts that occur, and where each begins and the last ends."""
    order = np.argsort(part, kind="stable")
    parts, begin = np.unique(part[order], return_index=True)
    return order, parts, np.append(begin, len(part))


def packed(docs: DataFrame, n_groups: int, window: int = WINDOW) -> DataFrame:
    """Rows of texts (block, row, doc_id, raw), and of blocks' marks (block, part, marks, places)."""
    id_field = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.LongType()), id_field, T.StructField("raw", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("marks", T.BinaryType()), T.StructField("places", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("suffix_dedup")
        block = TaskContext.get().partitionId() << 32
        marks: list[np.ndarray] = []
        places: list[np.ndarray] = []
        size, row, arrow = 0, 0, None

        def sent() -> pa.RecordBatch:
            all_marks, at = np.unique(np.concatenate(marks), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(places)).astype("<u4")
            order, parts, cuts = _dealt((all_marks >> np.uint64(21)) % np.uint64(n_groups))
            m, n = all_marks[order].astype("<u8"), n[order]
            none = pa.nulls(len(parts))
            columns = [pa.array(np.full(len(parts), block)), none.cast(pa.int64()), none.cast(arrow.field("doc_id").type), none.cast(pa.binary()), pa.array(parts.astype(np.int64))]
            columns += [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], type=pa.binary()) for x in (m, n)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            none = pa.nulls(batch.num_rows)
            columns = [pa.array(np.full(batch.num_rows, block)), pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), batch.column("raw"), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in slices(batches, 200):
            if arrow is None:
                arrow = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("raw", pa.binary()), ("part", pa.int64()), ("marks", pa.binary()), ("places", pa.binary())])
            batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw").cast(pa.binary())], names=["doc_id", "raw"])
            begin = 0
            for i, text in enumerate(batch.column("raw")):
                raw = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid else np.zeros(0, dtype=np.uint8)
                for _, slab in slabs(raw, window):
                    _, _, mark, n = runs(slab, gram(window), window)
                    marks.append(mark)
                    places.append(n)
                size += len(raw)
                if size >= BLOCK:
                    yield rows(batch.slice(begin, i + 1 - begin))
                    yield sent()
                    marks.clear()
                    places.clear()
                    size, row, begin, block = 0, 0, i + 1, block + 1
            if begin < batch.num_rows:
                yield rows(batch.slice(begin))
                row += batch.num_rows - begin
        if marks:
            yield sent()
        trim()

    return docs.select("doc_id", "raw").mapInArrow(pack, schema)


def mark_totals(blocks: DataFrame) -> DataFrame:
    """block, part, flags: for the marks that each block sent to each part 0 (one place in all texts), 1 or 2 (heavy); n_sent: how many are 1 or 2."""
    heavy = HEAVY

    def add(table: pa.Table) -> pa.Table:
        marks = [np.frombuffer(b, dtype="<u8") for b in table.column("marks").to_pylist()]
        _, at = np.unique(np.concatenate(marks), return_inverse=True)
        total = np.bincount(at, weights=np.frombuffer(b"".join(table.column("places").to_pylist()), dtype="<u4"))[at]
        flags = np.where(total > heavy, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        ends = np.cumsum([len(m) for m in marks])
        out = [flags[e - len(m) : e] for m, e in zip(marks, ends, strict=True)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "flags": pa.array([f.tobytes() for f in out], type=pa.binary()), "n_sent": pa.array([int((f > 0).sum()) for f in out], type=pa.int64())})

    return blocks.select("block", "part", "marks", "places").groupBy("part").applyInArrow(add, "block long, part long, flags binary, n_sent long")


def pieces(texts: DataFrame, totals: DataFrame, n_groups: int, n_parts: int, window: int = WINDOW) -> DataFrame:
    """block, part, texts, sizes, piece, row, at: the distinct pieces of text of each block, and where they stand."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        entering("suffix_dedup")
        flags = np.frombuffer(b"".join(right.sort_by("part").column("flags").to_pylist()), dtype=np.uint8)
        held = []  # of all runs: row, begin in the text, length, mark
        for row, text in zip(left.column("row").to_pylist(), left.column("raw"), strict=True):
            raw = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid else np.zeros(0, dtype=np.uint8)
            for at, slab in slabs(raw, window):
                begin, length, mark, _ = runs(slab, gram(window), window)
                held.append((np.full(len(begin), row), begin + at, length, mark))
        row, begin, length, mark = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0, dtype=np.int64)] * 4
        # The flags stand in the order in which the block's marks were sent.
        sent, which = np.unique(mark, return_inverse=True)
        own = np.zeros(len(sent), dtype=np.uint8)
        if len(sent):
            own[_dealt((sent >> np.uint64(21)) % np.uint64(n_groups))[0]] = flags
        flag = own[which]
        raws = dict(zip(left.column("row").to_pylist(), left.column("raw"), strict=True))
        dealt = [tuple(x[flag == 1] for x in (row, begin, length, mark))]
        for r, b, n in zip(*(x[flag == 2] for x in (row, begin, length)), strict=True):
            slab = np.frombuffer(raws[r].as_buffer(), dtype=np.uint8)[b : b + n + window - 1]
            begin2, length2, mark2, _ = runs(slab, long_gram(window), window)
            dealt.append((np.full(len(begin2), r), begin2 + b, length2, mark2))
        row, begin, length, mark = (np.concatenate(x) for x in zip(*dealt, strict=True))
        n_pieces = -(-length // PIECE)
        nth = np.arange(n_pieces.sum()) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        row, begin, mark = np.repeat(row, n_pieces), np.repeat(begin, n_pieces) + nth * PIECE, np.repeat(mark, n_pieces)
        size = np.minimum(np.repeat(length, n_pieces) - nth * PIECE, PIECE) + window - 1
        order, parts, cuts = _dealt((_mix(mark) >> np.uint64(21)) % np.uint64(n_parts))
        views = {r: memoryview(x.as_buffer()) for r, x in raws.items() if x.is_valid}
        out: dict[str, list] = {k: [] for k in ("texts", "sizes", "piece", "row", "at")}
        for a, b in zip(cuts, cuts[1:], strict=False):
            here = order[a:b]
            known: dict[bytes, int] = {}
            piece = [known.setdefault(bytes(views[r][p : p + n]), len(known)) for r, p, n in zip(row[here].tolist(), begin[here].tolist(), size[here].tolist(), strict=True)]
            out["texts"].append(b"".join(known))
            out["sizes"].append(np.array([len(t) for t in known], dtype="<i4").tobytes())
            out["piece"].append(np.array(piece, dtype="<i4").tobytes())
            out["row"].append(row[here].astype("<i4").tobytes())
            out["at"].append(begin[here].astype("<i8").tobytes())
        block = left.column("block")[0].as_py() if left.num_rows else None
        made = pa.table({"block": pa.array([block] * len(parts), type=pa.int64()), "part": pa.array(parts.astype(np.int64)), **{k: pa.array(v, type=pa.binary()) for k, v in out.items()}})
        trim()
        return made

    return texts.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(cut, "block long, part long, texts binary, sizes binary, piece binary, row binary, at binary")


class Suffixes:
    """Sorted windows of a string; windows begin at ``starts`` and lie within it."""

    def __init__(self, text: bytes, window: int = WINDOW):
        self.window = window
        self.n = len(text)
        self.text = text + bytes(MODULUS * 8 + 16)
        # The eight bytes from each position on, as a number of the same order; a view, not a copy.
        self.words = np.ndarray((len(self.text) - 7,), dtype=">u8", buffer=self.text, strides=(1,))
        inside = np.isin(np.arange(MODULUS), COVER)
        self.slot = np.where(inside, np.cumsum(inside) - 1, -1)
        shifted = inside[(np.arange(MODULUS)[:, None] + np.arange(MODULUS)[None, :]) % MODULUS]
        self.shift = (shifted[:, None, :] & shifted[None, :, :]).argmax(axis=2)
        self.ranks = self._cover_ranks()

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at].astype(np.uint64)

    def _by_prefix(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of their first ``MODULUS`` bytes, and marks where a new group of equal ones begins."""
        word = self.word(at)
        order = np.argsort(word, kind="stable")
        at, word = at[order], word[order]
        new = np.concatenate(([True], word[1:] != word[:-1])) if len(at) else np.zeros(0, dtype=bool)
        for skip in (8, 16, MODULUS - 8):
            tied = np.flatnonzero(~new | ~np.append(new[1:], True))
            if not len(tied):
                break
            group, word = np.cumsum(new[tied]), self.word(at[tied] + skip)
            order = np.lexsort((word, group))
            at[tied], word = at[tied][order], word[order]  # groups keep their places
            new[tied[1:]] |= word[1:] != word[:-1]
        return at, new

    def _index(self, at: np.ndarray) -> np.ndarray:
        """Place of cover positions in the array of ranks."""
        return at // MODULUS * len(COVER) + self.slot[at % MODULUS]

    def _cover_ranks(self) -> np.ndarray:
        """Ranks of all cover positions by at least ``window`` bytes; behind the end they are 0."""
        turns = self.n // MODULUS + 1
        at = (np.arange(turns)[:, None] * MODULUS + np.array(COVER)[None, :]).ravel()
        ranks = np.zeros((turns + 10) * len(COVER), dtype=np.int64)
        real = at[at < self.n]
        if not len(real):
            return ranks
        order, new = self._by_prefix(real)
        ranks[self._index(order)] = np.cumsum(new)
        have = MODULUS
        while have < self.window:
            step = have // MODULUS * len(COVER)
            own = self._index(real)
            following = own + step
            second = np.where(following < len(ranks), ranks[np.minimum(following, len(ranks) - 1)], 0)
            _, ranks[own] = np.unique(ranks[own] * (len(real) + 1) + second, return_inverse=True)
            ranks[own] += 1
            have *= 2
        return ranks

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Of pairs of equal first ``MODULUS`` bytes: is a before b (or equal, where asked)? By cover ranks."""
        by = self.shift[a % MODULUS, b % MODULUS]
        x, y = self.ranks[self._index(a + by)], self.ranks[self._index(b + by)]
        return (x < y) | (or_equal & (x == y))

    def _resolved(self, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ties of the first bytes put in order: all groups are merge-sorted at once, by cover ranks."""
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        run = 1
        while run < size.max(initial=0):
            long = size > run
            first, count = begin[long], size[long]
            base = np.repeat(first, count)
            own = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # place within the group
            total = np.repeat(count, count)
            block = own // run
            low = np.minimum((block ^ 1) * run, total)  # the run that this one merges with
            high = np.minimum(low + run, total)
            left, item = block % 2 == 0, at[base + own]
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():  # how many of the other run come first
                middle = (a + b) // 2
                other = at[base + np.minimum(middle, total - 1)]
                before = self.less(other, item, ~left) & open_
                a, b = np.where(before, middle + 1, a), np.where(open_ & ~before, middle, b)
            target = base + (block // 2) * 2 * run + (own % run) + (a - low)
            order = np.argsort(target, kind="stable")
            at[(base + own)] = item[order]
            run *= 2
        return at

    def buckets(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        """``starts`` split by leading bytes into buckets of about ``BUCKET``, one at a time."""
        word = self.word(starts)
        n = -(-len(starts) // BUCKET)
        some = np.sort(word[:: max(1, len(word) // 65536)])
        cuts = np.unique(some[np.arange(1, n) * len(some) // max(n, 1)])
        which = np.searchsorted(cuts, word, side="right")
        for i in range(len(cuts) + 1):
            yield starts[which == i]

    def _same(self, at: np.ndarray) -> np.ndarray:
        """Of neighbours i and i + 1: do they agree in the whole window?"""
        out = np.zeros(max(0, len(at) - 1), dtype=bool)
        left = np.arange(len(out))
        for skip in [*range(0, self.window - 7, 8), max(0, self.window - 8)]:
            if len(left):
                left = left[self.words[at[left] + skip] == self.words[at[left + 1] + skip]]
        out[left] = True
        return out

    def classes(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each bucket its windows in order and the number of the class of equal ones that each is in."""
        for bucket in self.buckets(starts):
            if len(bucket):
                at = self._resolved(*self._by_prefix(bucket))
                yield at, np.concatenate(([0], np.cumsum(~self._same(at))))


def repeated(texts: list[bytes], counts: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Of distinct pieces, each with the number of its places: the byte ranges covered by repeated windows."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    n = sizes - window + 1
    start_of = np.repeat(np.arange(len(texts)), n)
    starts = begin[start_of] + np.arange(len(start_of)) - np.repeat(np.cumsum(n) - n, n)
    suffixes = Suffixes(b"".join(texts), window)
    hit = np.zeros(suffixes.n + 1, dtype=bool)
    ends = begin + sizes
    for at, group in suffixes.classes(starts):
        times = np.bincount(group, weights=counts[np.searchsorted(ends, at, side="right")])
        hit[at[times[group] > 1]] = True
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    edge = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    edge = np.concatenate(([0], edge)) if hit[0] else edge
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # a run of hits lies in one piece: its last bytes start nothing
        piece = int(np.searchsorted(ends, a, side="right"))
        out[piece].append((a - int(begin[piece]), b - 1 + window - int(begin[piece])))
    return out


def ranges(sent: DataFrame, window: int = WINDOW) -> DataFrame:
    """block, rows, begins, ends: packed byte ranges of the texts' rows that repeated windows cover."""

    def sort(table: pa.Table) -> pa.Table:
        entering("suffix_dedup")
        known: dict[bytes, int] = {}
        of_block, counts = [], []
        for texts, sizes, piece in zip(*(table.column(k).to_pylist() for k in ("texts", "sizes", "piece")), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, dtype="<i4"))
            own = np.array([known.setdefault(texts[a:b], len(known)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], dtype=np.int64)
            of_block.append(own[np.frombuffer(piece, dtype="<i4")])
        counts = np.bincount(np.concatenate(of_block), minlength=len(known))
        found = repeated(list(known), counts, window)
        n = np.array([len(f) for f in found], dtype=np.int64)
        flat = np.array([r for f in found for r in f], dtype=np.int64).reshape(-1, 2)
        first = np.cumsum(n) - n
        out: dict[str, list] = {"rows": [], "begins": [], "ends": []}
        for own, row, at in zip(of_block, table.column("row").to_pylist(), table.column("at").to_pylist(), strict=True):
            times = n[own]
            which = np.repeat(first[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            base = np.repeat(np.frombuffer(at, dtype="<i8"), times)
            out["rows"].append(np.repeat(np.frombuffer(row, dtype="<i4"), times).astype("<i4").tobytes())
            out["begins"].append((base + flat[which, 0]).astype("<i8").tobytes())
            out["ends"].append((base + flat[which, 1]).astype("<i8").tobytes())
        trim()
        return pa.table({"block": table.column("block"), **{k: pa.array(v, type=pa.binary()) for k, v in out.items()}})

    return sent.groupBy("part").applyInArrow(sort, "block long, rows binary, begins binary, ends binary")


def _kept(texts: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept."""
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([texts.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", spans), T.StructField("kept", T.BinaryType())])

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        entering("suffix_dedup")
        row, begin, end = (np.frombuffer(b"".join(right.column(k).to_pylist()), dtype=t) for k, t in (("rows", "<i4"), ("begins", "<i8"), ("ends", "<i8")))
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        listed, kept, removed, sizes = [], [], [], []
        for r, raw in zip(left.column("row").to_pylist(), left.column("raw").to_pylist(), strict=True):
            raw = raw or b""
            a, b = np.searchsorted(row, [r, r + 1])
            far = np.maximum.accumulate(end[a:b])
            new = np.flatnonzero(np.concatenate(([True], begin[a + 1 : b] > far[:-1]))) if b > a else np.zeros(0, dtype=np.int64)
            starts = begin[a:b][new].tolist()
            stops = far[np.append(new[1:], b - a) - 1].tolist() if b > a else []
            listed.append([{"start": x, "end": y} for x, y in zip(starts, stops, strict=True)])
            kept.append(b"".join(raw[x:y] for x, y in zip([0, *stops], [*starts, len(raw)], strict=True)))
            sizes.append(len(raw))
            removed.append(len(raw) - len(kept[-1]))
        arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(sizes, type=pa.int64()), "n_removed": pa.array(removed, type=pa.int64()), "spans": pa.array(listed, type=arrow), "kept": pa.array(kept, type=pa.binary())})

    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(keep, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, select: list[Column] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end in bytes of the maximal removed runs) and kept (bytes), a row
    for each row of ``docs``; with ``select`` columns made of these, before the result is stored."""
    spark, paths = docs.sparkSession, []
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    size = own.agg(F.sum(F.octet_length("raw")).alias("n")).first().n or 0
    n_groups = max(1, size // (GROUP * (window - gram(window)) // 2))  # a mark for about half as many bytes as grams in a window
    made = packed(own, n_groups, window)
    path = f"{shared_dir(spark)}/repeats-blocks-{uuid.uuid4().hex}"
    schema = T.StructType([*made.schema, T.StructField("kind", T.StringType())])
    try:
        write(made.withColumn("kind", F.when(F.col("part").isNull(), "texts").otherwise("marks")), path, "kind")
        paths.append(path)
        # A table without rows has no folders: the whole is read, and pruned to one folder by its kind.
        totals = stored(mark_totals(spark.read.schema(schema).parquet(path).filter("kind = 'marks'")), "repeats-totals", paths)
        delete(spark, [f"{path}/kind=marks"])
        texts = spark.read.schema(schema).parquet(path).filter("kind = 'texts'").select("block", "row", "doc_id", "raw")
        n_sent = totals.agg(F.sum("n_sent").alias("n")).first().n or 0
        n_parts = max(1, n_sent * (window + (window - gram(window)) // 2) // PART)
        sent = pieces(texts, totals, n_groups, n_parts, window)
        found = stored(ranges(sent, window), "repeats-ranges", paths)
        kept = _kept(texts, found)
        return stored(kept if select is None else kept.select(*select), "repeats-kept")
    finally:
        delete(spark, paths)
