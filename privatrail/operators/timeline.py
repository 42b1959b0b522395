"""As-of lookups that stay parallel inside one busy key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(
    df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], bucket: Column, how: str = "last"
) -> DataFrame:
    """For every row, a running value over the rows strictly before it within its group.

    ``how`` is ``last`` (last non-null) or ``max``. Rows are windowed per (group, time
    bucket); what earlier buckets leave behind is one summary row per bucket, windowed
    separately and joined back. A group holding most of the rows is thus spread over its
    buckets, and the result is exact.
    """
    df = df.withColumn("_b", bucket)
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    at = F.struct(*order)
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def summed(n: str) -> Column:
        v = F.col(f"_v_{n}")
        return F.max(v) if how == "max" else F.max_by(v, F.when(v.isNotNull(), at))

    def run(name: str, w) -> Column:
        return F.max(name).over(w) if how == "max" else F.last(name, ignorenulls=True).over(w)

    summary = df.groupBy(*group, "_b").agg(*[summed(n).alias(f"_s_{n}") for n in values])
    carried = summary.select(*group, "_b", *[run(f"_s_{n}", across).alias(f"_c_{n}") for n in values])
    out = df.select("*", *[run(f"_v_{n}", inside).alias(f"_i_{n}") for n in values])
    out = out.join(carried, [*group, "_b"], "left")
    for n in values:
        merged = F.greatest(f"_i_{n}", f"_c_{n}") if how == "max" else F.coalesce(f"_i_{n}", f"_c_{n}")
        out = out.withColumn(n, merged).drop(f"_v_{n}", f"_i_{n}", f"_c_{n}")
    return out.drop("_b")
