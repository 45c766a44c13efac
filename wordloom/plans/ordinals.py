"""Positions and running sums over whole tables without a single-task window.

Rows are range-partitioned, sorted and written with the number of their partition and their place in it, so that all later
steps read the same partitioning; what precedes a partition comes from one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.plans.shared import written


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ordinals")


def with_ordinal(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """``name``: 1 for the first row in ``order``, which must not tie."""
    rows = _sorted(df, list(order))
    # one row a partition
    before = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")


def with_running_sum(df: DataFrame, value: Column, *order: Column, name: str = "running") -> DataFrame:
    """``name``: the sum of ``value`` up to and with each row in ``order``, which must not tie."""
    rows = _sorted(df.withColumn("_v", value), list(order))
    before = rows.groupBy("_part").agg(F.sum("_v").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_at", "_before", "_in", "_v")


def with_place(df: DataFrame, keys: list[str], *order: Column, name: str = "place") -> DataFrame:
    """``name``: 0 for the first row of its key in ``order``; a key's rows, however many, are sorted in many tasks."""
    from wordloom.plans.joins import spread_join

    at = with_ordinal(df, *[F.col(k) for k in keys], *order, name="_o").withColumn("_key", F.struct(*keys))
    first = at.groupBy("_key").agg(F.min("_o").alias("_first"))
    return spread_join(at, first, "_key").withColumn(name, F.col("_o") - F.col("_first")).drop("_o", "_first", "_key")
