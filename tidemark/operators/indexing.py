"""Numbers for distinct values and rows, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import sha256_bucket
from tidemark.sources.scratch import written


def starts_of_tasks(placed: DataFrame) -> DataFrame:
    """(task, before): how many rows of `placed` have a smaller task number, for each task that has rows."""
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    counts = placed.groupBy("task").agg(F.count("*").alias("n"))
    return counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def dense_index(df: DataFrame, column: str, first: int = 1, into: str = "index") -> DataFrame:
    """(column, into): each distinct value's place in sorted order, null left out.

    Values are range-partitioned and numbered within a partition; what stands before a partition comes from the
    partitions' counts, one row each.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = written(values.withColumn("_p", F.spark_partition_id()), "distinct-values")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = placed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return placed.withColumn("_k", within).join(F.broadcast(shift.select("_p", "_before")), "_p").select(column, (F.col("_k") + F.col("_before") + (first - 1)).cast("long").alias(into))


def bucketed_row_index(df: DataFrame, key: str, buckets: int, first: int = 1, into: str = "row_index") -> DataFrame:
    """df with a dense index in the order of (hash bucket, key); key is unique."""
    bucketed = df.withColumn("_b", sha256_bucket(F.col(key).cast("string"), buckets))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    shift = bucketed.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return bucketed.withColumn("_k", within).join(F.broadcast(shift.select("_b", "_before")), "_b").withColumn(into, (F.col("_k") + F.col("_before") + (first - 1)).cast("long")).drop("_k", "_b", "_before")


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """df with `into`: the sum of `value` over the rows of the group up to this one, in an order that has no ties.

    A group may span many ranges: sums run within a range, and what stands before it in the group comes from the ranges'
    sums, one row for each group and range. A hot group isn't brought to one task.
    """
    dealt = written(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_p", *group).agg(F.sum(value).alias("_n"))
    before = parts.select("_p", *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col("x._p") == F.col("y._p"), *[F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in group]]
    summed = dealt.withColumn("_within", F.sum(value).over(within))
    joined = summed.alias("x").join(before.alias("y"), same)
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("x._within") + F.col("y._before")).alias(into))
