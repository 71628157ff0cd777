"""Global order within groups of any size.

A window over a whole group would put that group in one task. Here the rows are
range-partitioned by (group, order), each range is summed on its own, and only
the per-range totals are accumulated, so a group that holds most of the data is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .semantics import null_safe_join
from .storage import settle


def prefix_sum(
    df: DataFrame, groups: list[str], order: list[Column], amount: Column, out: str
) -> DataFrame:
    """Add ``out`` = sum of ``amount`` over the rows before this one in its group.

    ``order`` must not leave ties between rows whose order matters.
    """
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keyed = keyed.withColumn("_amount", amount.cast("long"))
    by = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]
    ranges = keyed.repartitionByRange(*[F.col(g) for g in groups], *by)
    ranges = settle(ranges.withColumn("_range", F.spark_partition_id()), "ranges")

    before = Window.partitionBy(*groups).orderBy("_range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.groupBy(*groups, "_range")
        .agg(F.sum("_amount").alias("_part"))
        .withColumn("_start", F.coalesce(F.sum("_part").over(before), F.lit(0)))
        .drop("_part")
    )
    inside = Window.partitionBy(*groups, "_range").orderBy(*by)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.withColumn(
        "_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    )
    joined = null_safe_join(local, starts, [*groups, "_range"], "inner")
    return joined.withColumn(out, F.col("_start") + F.col("_inside")).drop(
        "_start", "_inside", "_range", "_amount", *[f"_o{i}" for i in range(len(order))]
    )


def number_rows(
    df: DataFrame, groups: list[str], order: list[Column], out: str, name: str = "ranges"
) -> DataFrame:
    """Add ``out`` = 1..n within each group, in the given order.

    Rows are shuffled once: ids grow by 1 along a sorted range, so the first id of a
    group in a range tells the place of all others.
    """
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    by = [F.col(c).asc_nulls_first() for c in [*groups, *[f"_o{i}" for i in range(len(order))]]]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = dealt.drop(*[f"_o{i}" for i in range(len(order))])
    dealt = settle(dealt.withColumn("_id", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("_range", F.shiftright("_id", 33))

    before = Window.partitionBy(*groups).orderBy("_range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*groups, "_range").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_part")
    ).withColumn("_start", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    joined = null_safe_join(dealt, settle(starts, "range_starts"), [*groups, "_range"], "inner")
    place = F.col("_start") + F.col("_id") - F.col("_first") + 1
    return joined.withColumn(out, place).drop("_start", "_first", "_range", "_id")


def top_rows(df: DataFrame, groups: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    The rank filter sits directly on the window, so Spark trims every partition
    to ``k`` rows per group before the shuffle.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
