"""The interaction audit against every order applied one filter after the other."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tessera.llm import filter_audit


def failures(rows):
    """Set of failed filters of each (id, text) row."""
    out = []
    for i, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        if len(words) < 100:
            failed.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            failed.add("C")
        if re.search(r"[#$%&*|]", t):
            failed.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows):
            failed.add("E")
        out.append(failed)
    return out


def brute(rows, labels):
    """All orders applied by removing documents one filter at a time. rows: (id, text, lang)."""
    failed = failures([(i, t) for i, t, _ in rows])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    found, shapley = {}, Counter()
    for part in {lang or "" for _, _, lang in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                found[part, order, step] = (len(left), len(removed), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in own), sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed))
                shapley[part, f] += len(removed)
                gone = gone + removed
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in found.items()}


def made(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return filter_audit.audit(docs, marks)


def test_audit_equals_every_order(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "ABCDEFGHI", "A#b", "c|d"]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([20, 300, 304])]) for _ in range(rng.choice([3, 99, 100, 140]))) for _ in range(40)]
    texts += ["", None, "  \x1f", "A" * 20, "x" * 100_000, " ".join(f"u{i}" for i in range(5000)), "$ " + " ".join(f"v{i}" for i in range(200))]
    rows = [(i, t, rng.choice(["en", "fr", None, ""])) for i, t in enumerate(texts + rng.choices(texts, k=40))]
    rows += [rows[3], rows[3], (None, texts[0], "en"), (None, None, "fr"), (5, texts[1], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (10_000, 1, 1)]
    found = made(spark, rows, labels).collect()
    assert len(found) == 4 * 600  # en, fr, de and the empty string, of which null is part
    assert {tuple(r) for r in found} == brute(rows, labels)


def test_empty_and_extra_columns(spark):
    assert made(spark, [], []).count() == 0
    docs = spark.createDataFrame([(1, "a", "en", 7, 9)], "doc_id long, text string, lang string, mask int, n int")
    marks = spark.createDataFrame([(1, 1, 1, "x")], "doc_id long, quality int, toxic int, lang string")
    rows = filter_audit.audit(docs, marks).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.good_lost, r.toxic_lost) for r in rows] == [(0, 1, 1, 1)] + [(0, 0, 0, 0)] * 4


@pytest.mark.parametrize("mask", range(1, 32))
def test_intervals_cover_every_order_once(mask):
    steps = {}
    for m, step, begin, end in filter_audit.intervals():
        if m == mask:
            for rank in range(begin, end):
                assert rank not in steps
                steps[rank] = step
    for rank, order in enumerate(filter_audit.orders()):
        assert steps[rank] == next(s for s, f in enumerate(order, 1) if mask & filter_audit.bit(f))
