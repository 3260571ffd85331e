"""Any scorer over rows: a function from a pandas frame to a series of numbers, run batch by batch on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def scored(df: DataFrame, keep: Sequence[str], scorer: Callable[[pd.DataFrame], pd.Series], into: str = "score") -> DataFrame:
    """The columns `keep` and the scorer's result for every row."""

    def run(batches):
        for rows in batches:
            out = rows[list(keep)].copy()
            out[into] = scorer(rows).astype(float)
            yield out

    return df.mapInPandas(run, T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.DoubleType())]))


def trend(rows: pd.DataFrame) -> pd.Series:
    """A scorer of series `ts`: the last point and half of its step from the one before, 0 at least."""
    last = rows["ts"].map(lambda t: float(t[-1] or 0) + 0.5 * (float(t[-1] or 0) - float(t[-2] or 0)))
    return last.clip(lower=0)


def value_bands(x: pd.Series) -> pd.DataFrame:
    """A value in hundredths, without its fraction, and whether it is over 100."""
    return pd.DataFrame({"cents": (x * 100).round().astype("int64"), "whole": x.astype("int64"), "high": x > 100})
