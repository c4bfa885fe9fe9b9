"""Array functions that Spark lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(values: Column) -> Column:
    """For each element of an array of whole numbers (not null) the sum of those before it.

    Sums of blocks of about the square root of the size come first, so the work grows with the size times its root."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, x: n + x)

    def sums(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int")), lambda b: total(F.slice(v, b * width + 1, width)))
        heads = let(blocks, lambda own: F.transform(own, lambda x, b: total(F.slice(own, 1, b))))
        return let(heads, lambda h: F.transform(v, lambda x, i: F.get(h, F.floor(i / width).cast("int")) + total(F.slice(v, i - i % width + 1, i % width))))

    return let(values, sums)
