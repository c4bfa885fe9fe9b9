"""Interaction audit of five document filters, over all orders in which they can be applied.

A document's failures form a mask of five bits. Whatever the order, the filter that removes it is the
first one of the mask, so under the orders in lexicographic rank (Lehmer rank, 0 to 119) a mask's
removals at step s cover intervals: one for each way to place s - 1 filters outside the mask and then
one inside, of length (5 - s)!. Each mask's counts are added at the beginning of its intervals and
subtracted at their end; prefix sums along the ranks give every order's removals without visiting
a document twice. The intervals of the 32 masks depend on nothing but the number of filters.

Documents are read once. Filters A to D are column expressions; for E the least id of each text is
needed: rows are summed up by (text digest, part, mask, labels) before the digest alone is brought
together, so a text that a third of the rows share is a few rows by then.

Failures: A under 100 words; B 100 * distinct words < 80 * words; C 100 * ``[A-Z]`` > 10 * code points;
D holds any of ``#$%&*|``; E identical to the text of a smaller id. Words are maximal runs of
``[^\\x20\\x09-\\x0D]``.

Defined results: a null text is the empty text, which fails A (and E beside an earlier empty one); a
null lang is the part ``""``; rows of one id and one text are not smaller than each other; a null id is
never smaller and has no smaller one; a document counts as good or toxic if any of its label rows says
so; labels of null or unknown ids count nowhere; repeated rows each count; texts of any length are
whole; an empty table gives no parts; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SIGNS = "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    cut = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    words, distinct = F.size(cut).cast("long"), F.size(F.array_distinct(cut)).cast("long")
    points = F.length(text).cast("long")
    capitals = points - F.length(F.translate(text, _CAPITALS, ""))
    failed = {"A": words < LEAST_WORDS, "B": 100 * distinct < DISTINCT_PERCENT * words, "C": 100 * capitals > CAPITAL_PERCENT * points, "D": text.rlike(SIGNS)}
    return sum((F.when(c, bit(k)).otherwise(0) for k, c in failed.items()), F.lit(0)).cast("int")


def orders() -> list[str]:
    """All orders of the filters; an order's place is its lexicographic rank."""
    return ["".join(p) for p in permutations(FILTERS)]


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): ranks at which a document of the mask is removed at the step."""
    n, found = len(FILTERS), []

    def place(mask: int, left: list[int], begin: int, step: int) -> None:
        block = factorial(len(left) - 1)
        for digit, f in enumerate(left):  # the Lehmer digit: how many of the filters left come before f
            low = begin + digit * block
            if mask >> f & 1:
                found.append((mask, step, low, low + block))
            else:
                place(mask, left[:digit] + left[digit + 1 :], low, step + 1)

    for mask in range(1, 1 << n):
        place(mask, list(range(n)), 0, 1)
    return found


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask of failures in each part."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text_mask(text).alias("mask"))
    marks = labels.select(F.col("doc_id").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").alias("toxic")).filter("id IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    # One row for each id and text (by the partitioning of the join), then for each text and kind of document.
    each = known.groupBy("id", "key", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    held = each.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"))
    first = held.withColumn("first", F.min("least").over(Window.partitionBy("key")))
    passed = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), passed.alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - passed).alias("n"))))
    parted = first.select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))
    return parted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and the filter's shapley total over all orders."""
    spark = docs.sparkSession
    counts = mask_counts(docs, labels, **columns)
    names = ["n", "good", "toxic"]
    # Difference arrays: +counts where an interval begins, -counts where it ends.
    at = spark.createDataFrame(intervals(), "mask int, step int, begin int, end int").withColumn("edge", F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign")))))
    at = at.select("mask", "step", "edge.rank", "edge.sign")
    steps = counts.join(F.broadcast(at), "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in names])
    # Totals of the part and of each filter; every part gets all ranks and steps, zeros included.
    failing = [F.sum(F.when(F.col("mask").bitwiseAND(bit(f)) > 0, F.col("n")).otherwise(0)).alias(f"fails_{f}") for f in FILTERS]
    alone = [F.sum(F.when(F.col("mask") == bit(f), F.col("n")).otherwise(0)).alias(f"alone_{f}") for f in FILTERS]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), *failing, *alone)
    grid = spark.createDataFrame([(i, o, s + 1, o[s]) for i, o in enumerate(orders()) for s in range(len(FILTERS))], "rank int, filter_order string, step int, filter string")
    parts = totals.select("part", F.explode(F.sequence(F.lit(0), F.lit(len(orders()) - 1))).alias("rank")).select("part", "rank", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    along = Window.partitionBy("part", "step").orderBy("rank")
    swept = parts.join(steps, ["part", "rank", "step"], "left").fillna(0, names).select("part", "rank", "step", *[F.sum(c).over(along).alias(c) for c in names])
    swept = swept.join(F.broadcast(grid), ["rank", "step"]).join(totals, "part")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step")), F.lit(0))
    own = {kind: F.coalesce(*[F.when(F.col("filter") == f, F.col(f"{kind}_{f}")) for f in FILTERS]) for kind in ("fails", "alone")}
    return swept.select(
        "part", "filter_order", "step", (F.col("total") - before).alias("kept"), F.col("n").alias("removed"), (own["fails"] - F.col("n")).alias("redundant"), own["alone"].alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
