"""User-defined aggregates with partial states: folded in each task, merged after a shuffle of states alone."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Groups whose states a task holds at once; then it hands them on and begins anew.
GROUPS = 10_000
#: States of one group that are merged at once, about.
SALTS = 32


class Fold:
    """An aggregate: state of some rows, merge of two states, result of a state. merge is associative and commutative."""

    #: Columns that `state` reads, and the DDL of what `result` gives.
    columns: Sequence[str] = ()
    schema: str = ""

    def state(self, rows: pd.DataFrame) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def result(self, state: Any) -> tuple:
        raise NotImplementedError


def folded(df: DataFrame, keys: Sequence[str], fold: Fold) -> DataFrame:
    """The keys and fold's results, one row for each combination of keys (null is a value).

    Tasks fold their rows into one state a group before the shuffle. The states of a group are merged in two steps, by
    salt and then all, so that a hot group's many states aren't one task's. An empty table gives no row.
    """
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for rows in batches:
            for key, own in rows.groupby(keys, dropna=False, sort=False):
                key, state = tuple(None if pd.isna(k) else k for k in key), fold.state(own)  # one null, whatever stands for it
                states[key] = fold.merge(states[key], state) if key in states else state
            if len(states) > GROUPS:
                yield _rows(keys, states)
                states = {}
        yield _rows(keys, states)

    def merged(rows: pd.DataFrame) -> Any:
        states = map(pickle.loads, rows["state"])
        state = next(states)
        for other in states:
            state = fold.merge(state, other)
        return state

    def key_of(rows: pd.DataFrame) -> tuple:
        return tuple(None if pd.isna(rows[k].iat[0]) else rows[k].iat[0] for k in keys)

    def by_salt(rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(keys, {key_of(rows): merged(rows)})

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame([*keys, *names], [(*key_of(rows), *fold.result(merged(rows)))])

    state_schema = StructType([*key_fields, StructField("state", BinaryType())])
    result_fields = StructType.fromDDL(fold.schema).fields
    names = [f.name for f in result_fields]
    states = df.select(*keys, *[c for c in fold.columns if c not in keys]).mapInPandas(partial, state_schema)
    salted = states.withColumn("_salt", F.spark_partition_id() % SALTS).groupBy(*keys, "_salt").applyInPandas(by_salt, state_schema)
    return salted.groupBy(*keys).applyInPandas(last, StructType([*key_fields, *result_fields]))


def _rows(keys: list[str], states: dict) -> pd.DataFrame:
    return _frame([*keys, "state"], [(*k, pickle.dumps(s)) for k, s in states.items()])


def _frame(names: list[str], rows: list[tuple]) -> pd.DataFrame:
    """Rows as plain objects, so that nulls in keys don't change a column's type."""
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


class Coverage(Fold):
    """How many rows there are and how many units of a line their spans [start, start + width) cover together.

    The state is the row count and the disjoint spans, sorted: at most one for each stretch that is covered.
    """

    schema = "n long, covered long"

    def __init__(self, start: str, width: int):
        self.columns, self.width = (start,), width

    def state(self, rows: pd.DataFrame) -> tuple[int, np.ndarray]:
        at = np.sort(rows[self.columns[0]].dropna().to_numpy(np.int64))
        return len(rows), self._joined(np.stack([at, at + self.width], axis=1))

    def merge(self, a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        spans = np.concatenate([a[1], b[1]])
        return a[0] + b[0], self._joined(spans[np.argsort(spans[:, 0], kind="stable")])

    def result(self, state: tuple[int, np.ndarray]) -> tuple[int, int]:
        return state[0], int((state[1][:, 1] - state[1][:, 0]).sum())

    @staticmethod
    def _joined(spans: np.ndarray) -> np.ndarray:
        """Sorted spans, those that meet as one."""
        if not len(spans):
            return spans
        reach = np.maximum.accumulate(spans[:, 1])
        first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
        return np.stack([spans[first, 0], np.concatenate([reach[first[1:] - 1], reach[-1:]])], axis=1)
