"""Consecutive numbers for a distributed table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from frota.session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number rows ``start, start+1, ...`` in the given order.

    A global sort leaves the rows range-partitioned; the number is the place inside the
    partition plus the rows of all earlier partitions. Only the per-partition counts, one row per
    task, are summed in one place. The sorted rows are materialised first, so both uses see the
    same partitions even if a lost task runs again.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_mono", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return (
        placed.join(F.broadcast(earlier), "_part")
        .withColumn(name, F.col("_before") + F.col("_mono").bitwiseAND(_LOW_BITS) + start)
        .drop("_mono", "_part", "_before")
    )


def running_sum(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``name``: the sum of ``weight`` over all rows before this one in the given order.

    As ``dense_ids``: rows are range-partitioned, sums run within partitions, and only one sum a partition is added up in one place.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_mono", 33))
    totals = placed.groupBy("_part").agg(F.sum(weight).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(earlier), "_part")
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .drop("_mono", "_part", "_before")
    )
