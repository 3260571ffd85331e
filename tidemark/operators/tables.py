"""Scans, slices and predicates over tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, name_or_path: str) -> DataFrame:
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def bucket_range(df: DataFrame, column: str, low: int, high: int, *conditions: Column) -> DataFrame:
    """Both ends inclusive. One job over all buckets asked for; partitions outside are pruned."""
    return df.where(reduce(lambda a, b: a & b, conditions, F.col(column).between(low, high)))


def time_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """start <= time < end."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp")))


def with_attributes(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items()], F.lit(True)))


# Targeting: attribute lists, an empty one restricts nothing ------------------------------------------------------------
def one_of(value: Column, wanted: Column) -> Column:
    return (F.size(wanted) == 0) | F.array_contains(wanted, value)


def any_of(values: Column, wanted: Column) -> Column:
    """values: an array; wanted: an array."""
    return (F.size(wanted) == 0) | F.arrays_overlap(values, wanted)


def none_of(values: Column, unwanted: Column) -> Column:
    return (F.size(unwanted) == 0) | ~F.arrays_overlap(values, unwanted)


def matches(keys: DataFrame | None, channel: Mapping[str, Column], attributes: Sequence[str], prefix: str = "") -> Column:
    """AND over attributes of: the channel's list is empty or has the key's value."""
    return reduce(lambda a, b: a & b, [one_of(F.col(prefix + a), channel[a]) for a in attributes])


def channels_intersect(a: Mapping[str, Column], b: Mapping[str, Column], attributes: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [(F.size(a[k]) == 0) | (F.size(b[k]) == 0) | F.arrays_overlap(a[k], b[k]) for k in attributes])
