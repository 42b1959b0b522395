"""Positions inside groups of any size: rows are dealt out by ranges of (group, order), never by group.

A group that holds a third of all rows stands in many ranges, and a row's position is its place in its range behind what
the earlier ranges hold of its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privatrail.llm.common import cut

PART, AT = "__part", "__at"


def ranged(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows, dealt out by ranges of (group, order) and sorted. Rows equal in all of these go to any range: the row's
    place in the input comes last, so that many equal rows do not meet in one task."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(c) for c in group] + order + [F.col("__tie")]
    return tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")


def place(rows: DataFrame, group: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """rows with PART and AT, and the table of (group, PART): `first` (the least AT), `before` (rows of the group in
    earlier parts) and `n` (rows here) and `size` (of the whole group). A row's position is AT - first + before. Both are written."""
    at = F.monotonically_increasing_id()  # numbers the rows of a partition in their order
    placed = ranged(rows, group, order).select(*rows.columns, at.alias("__n"))
    placed = cut(placed.select(*rows.columns, F.shiftright("__n", 33).alias(PART), F.col("__n").bitwiseAND((1 << 33) - 1).alias(AT)))
    here = placed.groupBy(*group, PART).agg(F.min(AT).alias("first"), F.count(F.lit(1)).alias("n"))
    # one row a part: small whatever the group
    parts = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = parts.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    return placed, cut(here.select(*group, PART, "first", "n", before, F.sum("n").over(parts).alias("size")))


def running(df: DataFrame, keys: list[str], at: str, sums: list[str], last: int, fan: int = 4096) -> DataFrame:
    """df with each of `sums` replaced by its sum over the rows of `keys` up to `at` (gapless, at most `last`). Sums run
    inside blocks of `fan` rows, and the blocks' totals run in the same way, so no task holds a long key's rows."""
    rest = [c for c in df.columns if c not in sums]
    blocked = df.withColumn("__block", F.floor(F.col(at) / fan))
    window = Window.partitionBy(*keys, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.select(*rest, "__block", *[F.sum(c).over(window).alias(c) for c in sums])
    if last < fan:
        return inside.drop("__block")
    totals = blocked.groupBy(*keys, "__block").agg(*[F.sum(c).alias(c) for c in sums]).withColumnRenamed("__block", "__of")
    carried = running(totals, keys, "__of", sums, last // fan, fan)
    carried = carried.select(*keys, (F.col("__of") + 1).alias("__block"), *[F.col(c).alias(f"__before_{c}") for c in sums])
    joined = inside.join(carried, [*keys, "__block"], "left")
    return joined.select(*rest, *[(F.col(c) + F.coalesce(f"__before_{c}", F.lit(0))).alias(c) for c in sums])
