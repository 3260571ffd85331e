"""Sketches that are kept by day and merged over days: distinct counts by registers, quantiles by Spark's KLL sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct sketch are numbered by so many hex digits of a value's hash; 4096 have a standard error of 1.6 %.
REGISTER_DIGITS = 3
REGISTERS = 16**REGISTER_DIGITS
#: Hex digits after those, whose leading zeros a register keeps the most of.
TAIL_DIGITS = 13
#: Items that a quantile sketch keeps about: ranks are within 0.8 % with a confidence of 99 %.
QUANTILE_ITEMS = 400


def register(value: Column) -> tuple[Column, Column]:
    """The number of a value's register and its rank there: one more than the leading zeros of the rest of its MD5."""
    digest = F.md5(value.cast("string").cast("binary"))
    tail = F.conv(F.substring(digest, REGISTER_DIGITS + 1, TAIL_DIGITS), 16, 10).cast("long")
    used = F.when(tail > 0, F.length(F.bin(tail))).otherwise(0)
    return F.conv(F.substring(digest, 1, REGISTER_DIGITS), 16, 10).cast("int"), (4 * TAIL_DIGITS + 1 - used).cast("int")


def distinct_sketch(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, register, rank): at most REGISTERS rows for each combination of keys, whatever the number of values.

    The greatest rank of each register; so the sketch depends on the set of values alone, and batch and stream give the
    same one. A null value is none. Works on a stream, with a watermark on a window among the keys.
    """
    number, rank = register(F.col(value))
    return df.where(F.col(value).isNotNull()).withColumn("register", number).groupBy(*keys, "register").agg(F.max(rank).alias("rank"))


def merged_sketch(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of the same keys as one; keys may be fewer than those that the sketches were made by."""
    return sketches.groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def sliding_sketch(daily: DataFrame, keys: Sequence[str], days: int, day: str = "day", into: str = "first_day") -> DataFrame:
    """Daily sketches merged over every window of some days that holds one of them and ends by the last one; day is a
    date. Registers are copied into windows, values never."""
    last = F.broadcast(daily.agg(F.max(day).alias("_last")))  # one row
    firsts = daily.withColumn(into, F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_sub(F.col(day), k))))
    return merged_sketch(firsts.join(last, F.date_add(into, days - 1) <= F.col("_last")), [into, *keys])


def distinct_estimate(sketches: DataFrame, keys: Sequence[str], into: str) -> DataFrame:
    """(keys, into): the number of distinct values, by the harmonic mean of the registers; by empty ones if there are few
    values. The standard error is 1.04 / sqrt(REGISTERS)."""
    m = REGISTERS
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = sketches.groupBy(*keys).agg(F.count("*").alias("full"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("sum"))
    raw = alpha * m * m / (F.col("sum") + m - F.col("full"))
    few = m * F.log(m / (m - F.col("full")))
    return sums.select(*keys, F.round(F.when((raw <= 2.5 * m) & (F.col("full") < m), few).otherwise(raw)).cast("long").alias(into))


def quantile_sketch(df: DataFrame, keys: Sequence[str], value: str, items: int = QUANTILE_ITEMS) -> DataFrame:
    """(keys, sketch, n): a sketch of bounded size of each group's values; nulls are none."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(items)).alias("sketch"), F.count("*").alias("n"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], ranks: Sequence[float]) -> DataFrame:
    """(keys, quantiles, n) of sketches made by more keys: values at about these ranks, between 0 and 1."""
    at = F.array(*[F.lit(float(r)) for r in ranks])
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*keys, F.kll_sketch_get_quantile_double("sketch", at).alias("quantiles"), "n")
