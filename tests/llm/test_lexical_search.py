"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    """(item id, rank, doc_id, score), rows in order of items."""
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in found if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w, times in asked.items() if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(n=400, seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["Été", "ÉTÉ", "straße", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [rng.choice([" ", "-", "\x00", "_"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 40, 300]))) for _ in range(n)]
    texts += ["", None, "...", "W1 w1 W2", " ".join(rng.choices(vocabulary, weights, k=60_000))]
    texts += [texts[3]] * 50  # ties of many
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30])))) for j in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, texts[3]), (104, "w1 w1 w1 w2"), (104, "w5 w6"), (None, "w7 Été")]
    return list(enumerate(texts)), items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    docs += [(3, docs[3][1]), (None, docs[3][1]), (None, docs[3][1]), (7, "w1")]
    want = in_order(brute(docs, items))
    assert in_order(lexical_search.search(*frames(spark, docs, items)).collect()) == want
    # More blocks of queries, and of postings in a task.
    monkeypatch.setattr(lexical_search, "POSTINGS", 500)
    a, b = frames(spark, docs, items)
    assert in_order(lexical_search.search(a.coalesce(2), b, block_chars=200).collect()) == want


def test_empty_tables_and_extra_columns(spark):
    docs, items = frames(spark, [(1, "a b"), (2, None)], [(1, "B")])
    empty = lexical_search.search(docs.limit(0), items)
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.filter("doc_id = 2"), items).count() == 0
    wide = docs.selectExpr("*", "1 AS n", "'x' AS terms", "2 AS query", "0 AS rank")
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical_search.search(wide, items.selectExpr("*", "9 AS doc_id")).collect()] == [(1, 1, 1)]


def block(rng, n_docs, n_terms, copies=0):
    """Lists over random postings; the last ``copies`` documents are equal."""
    counts = [{t: rng.choice([1, 1, 2, 5]) for t in rng.sample(range(n_terms), rng.randint(1, n_terms // 2))} for _ in range(n_docs)]
    counts += [dict(counts[0]) for _ in range(copies)]
    lengths = [sum(c.values()) for c in counts]
    sizes = np.array([len(c) for c in counts])
    numbers = np.array([t for c in counts for t in sorted(c)])
    tfs = np.array([c[t] for c in counts for t in sorted(c)])
    weights = np.array([rng.randint(0, 9000) for _ in range(n_terms)])
    return counts, lexical_search.Lists(np.array(lengths), sizes, numbers, tfs, weights, len(counts), sum(lengths))


def test_best_positions_stop_early_and_lose_nothing():
    rng = random.Random(11)
    early = 0
    for turn in range(40):
        counts, lists = block(rng, 3000, 12, copies=turn * 5)
        own = np.array(sorted(rng.sample(range(12), rng.choice([1, 2, 4]))))
        times = np.array([rng.choice([1, 1, 3]) for _ in own])
        at = lists.look_up(np.arange(len(counts)), own)
        score = (np.where(at >= 0, lists.impact[at], 0) * times).sum(axis=1)
        want = [(int(score[d]), int(d)) for d in np.lexsort((np.arange(len(score)), -score))[:10] if score[d] > 0]
        found, looked = lists.best(own, times, 10)
        assert found == want
        early += looked < len(counts) // 2
        if want:  # a bar known from other blocks: what meets it stays
            assert lists.best(own, times, 10, want[-1][0])[0] == want
            assert lists.best(own, times, 10, want[0][0] + 1)[0] == []
    assert early >= 20
