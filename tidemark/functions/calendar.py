"""Columns over days, hours and intervals. All times are UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(time: Column) -> Column:
    """yyyy-MM-dd of a timestamp or of its text."""
    return F.substring(time.cast("string"), 1, 10)


def epoch_seconds(time: Column) -> Column:
    return F.unix_timestamp(time.cast("timestamp"))


def interval_start(seconds: Column, step: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(step))


def interval_starts(first: Column, last: Column, step: int) -> Column:
    """All starts of intervals from that of `first` through that of `last`."""
    return F.sequence(interval_start(first, step), interval_start(last, step), F.lit(step).cast("long"))


def days_back(last: Column, n: int) -> Column:
    """The n days that end with `last`."""
    return F.sequence(F.date_sub(last, n - 1), last, F.expr("interval 1 day"))


def with_dashes(day: Column) -> Column:
    """yyyyMMdd -> yyyy-MM-dd; null where the text has another length."""
    return F.when(F.length(day) == 8, F.date_format(F.to_date(day, "yyyyMMdd"), "yyyy-MM-dd"))


def without_dashes(day: Column) -> Column:
    return F.when(F.length(day) == 10, F.date_format(F.to_date(day, "yyyy-MM-dd"), "yyyyMMdd"))


def weekday_angle(day: Column) -> Column:
    """Monday 0, in radians of a week."""
    return F.weekday(day) * F.lit(2 * math.pi / 7)


def windows_before(today: Column, n: int, count: int = 30) -> Column:
    """`count` windows of n consecutive days: the first days, the last window ending the day before `today`."""
    return F.sequence(F.date_sub(today, n + count - 1), F.date_sub(today, n), F.expr("interval 1 day"))


def hour_points(first_day: Column, last_day: Column, first_hour: Column, last_hour: Column) -> Column:
    """Timestamps of each hour from the first through the last of a range."""
    begin = F.to_timestamp(first_day) + F.make_dt_interval(F.lit(0), first_hour)
    end = F.to_timestamp(last_day) + F.make_dt_interval(F.lit(0), last_hour)
    return F.when(begin <= end, F.sequence(begin, end, F.expr("interval 1 hour"))).otherwise(F.array().cast("array<timestamp>"))
