"""Positions within groups of any size.

A window over a group sorts the whole group in one task. Here values are counted, range-partitioned
over (group, value) and numbered inside each range; the ranges' totals, one row per range and group,
give the offsets. No task holds more than its range, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, parallelism


def value_positions(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df's rows (distinct in group and order, with a bigint column n: how many rows each stands
    for) with ``before``: how many rows of the group come before it."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(parallelism(spark), *[F.col(g) for g in group], *order)
    placed = cut(ranged.withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_range").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = placed.join(totals, [*group, "_range"])
    return joined.withColumn("before", F.col("before") + F.col("_offset")).drop("_range", "_offset")
