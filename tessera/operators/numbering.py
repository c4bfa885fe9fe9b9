"""Gap-free numbers and ranks in a total order, without a task that sees all rows.

Rows are dealt by ranges of the order and sorted there, which a stored table fixes; a row's number is
its place in its part and the rows of the parts before. What meets on the driver is one count a part.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import stored


def numbered(df: DataFrame, order: list[Column], name: str = "number", start: int = 0) -> DataFrame:
    """``df`` with numbers from ``start + 1`` on in the given order, which should tell all rows apart."""
    spark = df.sparkSession
    held = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", 33)
    counts = sorted((r.part, r.n) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, accumulate((n for _, n in counts), initial=start), strict=False)], "__part long, __before long")
    local = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("__part", part).join(before, "__part").withColumn(name, F.col("__before") + local + 1).drop("__part", "__before", "__place")


def ranked_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", size: str | None = None) -> DataFrame:
    """Ranks from 1 within each group (nulls are a group) and, if named, the group's size. A group of any size is
    spread over many tasks."""
    held = numbered(df, [*(F.col(b) for b in by), *order], "__number")
    groups = held.groupBy(*by).agg(F.min("__number").alias("__first"), F.count("*").alias("__size")).select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], "__first", "__size")
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    out = held.join(groups, same).withColumn(name, F.col("__number") - F.col("__first") + 1)
    if size is not None:
        out = out.withColumn(size, F.col("__size"))
    return out.drop("__number", "__first", "__size", *[f"__by{i}" for i in range(len(by))])
