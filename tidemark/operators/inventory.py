"""Inventory estimates for targeting channels."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.amounts import H


def inventory_documents(inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(doc_id, body): a key's JSON document, days in order, each with its hours' h0..h3 and total."""
    hours = inventory.groupBy(*keys, "day").agg(F.array_sort(F.collect_list(F.struct("hour", *H, F.expr(" + ".join(H)).alias("total")))).alias("hours"))
    docs = hours.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "hours"))).alias("predictions"))
    key = F.concat_ws(",", *keys)
    return docs.select(key.alias("doc_id"), F.to_json(F.struct(key.alias("uckey"), *keys, "predictions")).alias("body"))


def hourly_sums(inventory: DataFrame, keys: Sequence[str], factor: Column | None = None) -> DataFrame:
    times = F.lit(1.0) if factor is None else factor
    return inventory.groupBy(*keys).agg(*[F.sum(F.col(h) * times).alias(h) for h in H])


def booked_by_channel(fitting: DataFrame, allocated: DataFrame) -> DataFrame:
    """id, day, booked: what bookings leave a channel short of on each day.

    fitting: id, day, ands, inside: how much of each bucket's inventory fits the channel. allocated: day, ands, amount,
    allocated: what the bookings have been given of each bucket. A bucket's allocations are served from its inventory
    outside the channel first; what that can't hold is booked within it. Buckets that the channel doesn't meet can hold
    all that they have given, so they have no row.
    """
    outside = F.col("amount") - F.col("inside")
    over = fitting.join(allocated, ["day", "ands"]).select("id", "day", F.greatest(F.col("allocated") - outside, F.lit(0)).alias("over"))
    return over.groupBy("id", "day").agg(F.sum("over").alias("booked")).where("booked > 0")


def recursive_estimate(counts: DataFrame, key: str, order: str, value: str, steps: str) -> DataFrame:
    """(key, estimate): `steps` times the mean of a line's next value and the plain mean joins the list; the last one.

    counts: at most some dozens of rows for each key (its windows), with the number of steps in each row.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values(order)[value].astype(float).tolist()
        for _ in range(int(rows[steps].iloc[0])):
            n = len(y)
            x = [i - (n - 1) / 2 for i in range(n)]
            mean = sum(y) / n
            slope = sum(a * b for a, b in zip(x, y)) / s if (s := sum(a * a for a in x)) else 0.0
            y.append((mean + slope * (n - (n - 1) / 2) + mean) / 2)
        return pd.DataFrame({key: [rows[key].iloc[0]], "estimate": [y[-1]]})

    kind = dict(counts.dtypes)[key]
    return counts.groupBy(key).applyInPandas(run, f"{key} {kind}, estimate double")
