"""Columns over series (arrays in day order; null: missing) and over vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def present(ts: Column) -> Column:
    return F.filter(ts, lambda x: x.isNotNull())


def nonzero(ts: Column) -> Column:
    return F.filter(ts, lambda x: x.isNotNull() & (x != 0))


def total(ts: Column) -> Column:
    """Sum of the points that are there, as a long."""
    return F.aggregate(ts, F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v, F.lit(0)).cast("long"))


def popularity(ts: Column) -> Column:
    """Total over the full length."""
    return F.when(F.size(ts) > 0, total(ts) / F.size(ts)).otherwise(F.lit(0.0))


def densified(counts: Column, days: Column) -> Column:
    """A map day -> count as an array over days: null where the day is missing or its count is 0."""
    return F.transform(days, lambda d: F.nullif(F.try_element_at(counts, d), F.lit(0).cast("long")))


def zero_filled(ts: Column) -> Column:
    return F.transform(ts, lambda x: F.coalesce(x, F.lit(0)))


def median(ts: Column) -> Column:
    """Median of the points that are there; null without any."""
    s = F.array_sort(present(ts).cast("array<double>"))
    n = F.size(s)
    at = lambda i: F.try_element_at(s, F.greatest(i.cast("int"), F.lit(1)))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2)


def middle(value: Column, accuracy: int | None = None) -> Column:
    """The aggregate median: exact, or by a mergeable sketch within 1 / accuracy of the rank for large tables."""
    half = F.lit(0.5)
    return F.percentile(value, half) if accuracy is None else F.percentile_approx(value, half, accuracy)


def imputed_with_median(ts: Column, zeros: bool = True) -> Column:
    """Missing points (and zeros) replaced by the whole-number median of the non-zero ones, 0 if there is none."""
    m = F.coalesce(F.floor(median(nonzero(ts))), F.lit(0)).cast("long")
    return F.transform(ts, lambda x: F.when(x.isNull() | ((x == 0) if zeros else F.lit(False)), m).otherwise(x.cast("long")))


def denoised(ts: Column, percent: float = 10.0) -> Column:
    """Points of at most mean of the non-zero points / percent become 0."""
    n = nonzero(ts).cast("array<double>")
    m = F.when(F.size(n) > 0, _sum(n) / F.size(n)).otherwise(F.lit(0.0))
    return F.transform(ts, lambda x: F.when(x > m / percent, x).otherwise(F.lit(0)).cast("long"))


def log_series(ts: Column) -> Column:
    return F.transform(zero_filled(ts), lambda x: F.log1p(x.cast("double")))


def first_active(ts: Column) -> Column:
    """Index of the first point over 0, -1 without any."""
    return F.coalesce(F.array_position(F.transform(ts, lambda x: F.coalesce(x > 0, F.lit(False))), True), F.lit(0)).cast("int") - 1


def last_active(ts: Column) -> Column:
    i = first_active(F.reverse(ts))
    return F.when(i >= 0, F.size(ts) - 1 - i).otherwise(F.lit(-1))


def vector_sum(vectors: Column) -> Column:
    """Element-wise sum of arrays of any lengths, null as 0."""
    return F.aggregate(vectors, F.array().cast("array<double>"), lambda a, b: F.zip_with(a, b.cast("array<double>"), lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclid_similarity(a: Column, b: Column, dimensions: int) -> Column:
    """sqrt(dimensions) minus the distance."""
    return F.sqrt(F.lit(float(dimensions))) - F.sqrt(F.greatest(dot(a, a) + dot(b, b) - 2 * dot(a, b), F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit_map(m: Column) -> Column:
    norm = F.sqrt(_sum(F.transform(F.map_values(m), lambda v: v * v)))
    return F.transform_values(m, lambda k, v: v / F.nullif(norm, F.lit(0.0)))


def pairs_to_map(counts: Column) -> Column:
    """array of 'key:count' -> map of strings. Of a key that comes twice the last count stays."""
    split = F.transform(counts, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring_index(x, ":", -1).alias("v")))
    last = F.filter(split, lambda x, i: ~F.exists(F.slice(split, i + F.lit(2), F.size(split)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def one_hot(value: Column, values: Sequence[str]) -> list[Column]:
    return [F.when(value == v, 1).otherwise(0) for v in values]


def padded(x: Column, n: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0), F.greatest(F.lit(n) - F.size(x), F.lit(0))))


def _by_shape(ts: pd.Series, *parameters: pd.Series):
    """(row numbers, matrix of the series, parameters) for rows of one length and parameters: one matrix, not many rows."""
    length = ts.map(len)
    for (n, *values), rows in pd.DataFrame({"n": length, **{str(i): p for i, p in enumerate(parameters)}}).reset_index(drop=True).groupby(["n", *map(str, range(len(parameters)))]):
        at = rows.index.to_numpy()
        yield at, np.array([np.asarray(ts.iloc[i], dtype=float) for i in at]).reshape(len(at), int(n)), values


def _medians(x: np.ndarray, window: int) -> np.ndarray:
    """Centered medians along rows, filled from the nearest full window."""
    return pd.DataFrame(x.T).rolling(int(window), center=True).median().bfill().ffill().to_numpy().T if x.size else x


def _roll(ts: pd.Series, window: pd.Series) -> pd.Series:
    out = [None] * len(ts)
    for at, x, (w,) in _by_shape(ts, window):
        for i, row in zip(at, _medians(x, w)):
            out[i] = row.tolist()
    return pd.Series(out)


def _clean(ts: pd.Series, half: pd.Series, sigmas: pd.Series) -> pd.DataFrame:
    cleaned, counts = [None] * len(ts), [0] * len(ts)
    for at, x, (h, n) in _by_shape(ts, half, sigmas):
        m = _medians(x, 2 * int(h))
        far = np.abs(x - m)
        out = (far >= n * 1.4826 * _medians(far, 2 * int(h))) & (far > 0)
        fixed = np.where(out, m, x)
        for k, i in enumerate(at):
            cleaned[i], counts[i] = fixed[k].tolist(), int(out[k].sum())
    return pd.DataFrame({"ts": cleaned, "outliers": counts})


def _banded(ts: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    zeros = ts.map(lambda x: int((np.asarray(x, dtype=float) == 0).sum()))
    out = [None] * len(ts)
    for at, x, (lo, hi, z) in _by_shape(ts, low, high, zeros):
        n = x.shape[1]
        if n:
            a, b = np.maximum(np.quantile(x, lo, axis=1), 4.0)[:, None], np.quantile(x, hi, axis=1)[:, None]
            x = np.where((x >= a) & (x <= b), x, _medians(x, min(max(n // 2, 2 * int(z), 1), n)))
        for k, i in enumerate(at):
            out[i] = x[k].tolist()
    return pd.Series(out)


def rolling_median(ts: Column, window: Column) -> Column:
    """Centered median of `window` points, filled from the nearest full window at the ends. ts isn't null."""
    return F.pandas_udf(_roll, "array<double>")(ts.cast("array<double>"), window.cast("int"))


def hampel(ts: Column, half_window: int, sigmas: float) -> Column:
    """struct(ts, outliers): points at least sigmas * 1.4826 * rolling MAD from the rolling median take the median."""
    return F.pandas_udf(_clean, "struct<ts: array<double>, outliers: int>")(zero_filled(ts).cast("array<double>"), F.lit(half_window), F.lit(float(sigmas)))


def denoised_band(ts: Column, low: float, high: float) -> Column:
    """Points outside [max(quantile low, 4), quantile high] take the rolling median of max(n // 2, 2 * zeros) points."""
    return F.pandas_udf(_banded, "array<double>")(zero_filled(ts).cast("array<double>"), F.lit(float(low)), F.lit(float(high)))


def autocorrelation(ts: Column, lag: int, least: int = 3) -> Column:
    """0.5 r(lag) + 0.25 r(lag - 1) + 0.25 r(lag + 1); null where a lag has at most `least` pairs or no variance."""

    def r(k: int) -> Column:
        x = zero_filled(ts).cast("array<double>")
        n = F.size(x) - k
        a, b = F.slice(x, 1, F.greatest(n, F.lit(0))), F.slice(x, k + 1, F.greatest(n, F.lit(0)))
        ma, mb = _sum(a) / n, _sum(b) / n
        cov = _sum(F.zip_with(a, b, lambda u, v: (u - ma) * (v - mb)))
        va, vb = _sum(F.transform(a, lambda u: (u - ma) * (u - ma))), _sum(F.transform(b, lambda v: (v - mb) * (v - mb)))
        return F.when((n > least) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))

    return 0.5 * r(lag) + 0.25 * r(lag - 1) + 0.25 * r(lag + 1)
