"""Removal of long repeats against comparing every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import queries, suffix_dedup


def brute(texts, window):
    """(n_bytes, n_removed, spans, kept) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + window] for r in raws for p in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for p in range(len(r) - window + 1):
            if seen[r[p : p + window]] > 1:
                gone[p : p + window] = True
        gone[len(r)] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8))))).tolist()
        out.append((len(r), int(gone.sum()), list(zip(edge[::2], edge[1::2], strict=True)), bytes(np.frombuffer(r, dtype=np.uint8)[~gone[:-1]])))
    return out


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(200)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [say(k) for k in (12, 60, 150, 400)] + ["=" * 700, "ab" * 300, "x" * 199, "y" * 200, "abcdefg" * 90]
    texts = [say(rng.choice([1, 30, 200])) + rng.choice(passages + [""]) + say(rng.choice([0, 3, 60])) + rng.choice(passages + [""]) for _ in range(n)]
    texts += ["", None, "short", texts[0], texts[0], texts[1][:400], texts[1][3:], "=" * 5000, "ab" * 1500, say(3000)]
    return texts


def found(spark, texts, window, partitions=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    rows = sorted(suffix_dedup.remove_repeats(docs, window=window).collect(), key=lambda r: r.doc_id)
    return [(r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows]


@pytest.mark.parametrize("window", [40, 200])
def test_removal_equals_brute_force(spark, monkeypatch, window):
    texts = corpus()
    want = brute(texts, window)
    assert any(w[1] for w in want) and any(not w[1] for w in want)
    assert found(spark, texts, window) == want
    # Small blocks, slabs, pieces, parts and buckets; every mark of more than three places is heavy.
    for name, value in {"BLOCK": 3000, "SLAB": 500, "PIECE": 64, "PART": 5000, "GROUP": 50, "HEAVY": 3, "BUCKET": 300}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    assert found(spark, texts, window) == want


def test_suffixes_are_sorted():
    """Neighbours in the order of suffixes, and equal windows in one class, on strings with long ties."""
    rng = random.Random(9)
    base = bytes(rng.choice(b"abc") for _ in range(900))
    text = base + base[100:700] + bytes(rng.choice(b"ab") for _ in range(500)) + base[:450] + b"z" * 700
    for bucket in (10_000, 100):
        suffix_dedup.BUCKET, before = bucket, suffix_dedup.BUCKET
        try:
            order = []
            for at, group in suffix_dedup.Suffixes(text).classes(np.arange(len(text) - 199)):
                order += [text[p : p + 200] for p in at.tolist()]
                windows = [text[p : p + 200] for p in at.tolist()]
                assert [a == b for a, b in zip(windows, windows[1:], strict=False)] == [a == b for a, b in zip(group, group[1:], strict=False)]
            assert order == sorted(order) and len(order) == len(text) - 199
        finally:
            suffix_dedup.BUCKET = before


def test_cover_shifts():
    s = suffix_dedup.Suffixes(b"x" * 400)
    for a in range(31):
        for b in range(31):
            assert (a + s.shift[a, b]) % 31 in suffix_dedup.COVER and (b + s.shift[a, b]) % 31 in suffix_dedup.COVER


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "q" * 300), (1, None), (1, "q" * 199), (1, ""), (2, "q" * 200 + "r" * 10)], "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS raw", "2 AS part")
    rows = {(r.doc_id, r.n_bytes): (r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert rows == {(None, 300): (300, b""), (1, 0): (0, b""), (1, 199): (0, b"q" * 199), (2, 210): (200, b"r" * 10)}
    empty = suffix_dedup.remove_repeats(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]


def test_query_on_whole_table(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, w[0], w[1], len(w[2]), hashlib.sha256(w[3]).hexdigest()) for r, w in zip(texts, brute([r.text for r in texts], 200), strict=True)}
    assert {tuple(r) for r in queries.op12_suffix_dedup(spark, sf).collect()} == want
