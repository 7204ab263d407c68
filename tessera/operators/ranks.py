"""Ranks and ordered selections without a task a group: range partitions, their totals, and prefix sums of those."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import materialize


def _parted(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df in range partitions by (by, order), each row with the number of its own; written, so that a row keeps it."""
    return materialize(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranked")


def with_rank(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with row_number() over (partition by `by` order by `order`), a group of any size spread over many tasks.

    A row's rank is its place within the part of its group that lies in its range partition, plus
    the rows of the group in the partitions before.  A null in `by` is a group of its own.  No `by`: the
    rank among all rows.
    """
    parted = _parted(df, by, order)
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = parted.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_at"), "_before")
    same = [F.col("_part") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]]
    placed = parted.withColumn("_inside", F.row_number().over(inside)).join(starts, same)
    return placed.withColumn(name, F.col("_inside") + F.col("_before")).select(*df.columns, name)
