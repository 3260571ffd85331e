"""Bookings, booking buckets and high-water-mark allocation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.amounts import behaviour_ratio
from tidemark.operators.graph import connected_components
from tidemark.operators.indexing import running_sum
from tidemark.operators.levels import placed_by_level, served_by_level
from tidemark.sources.scratch import written

#: Rows (a bucket with a booking) of a component up to which one task allocates it; larger ones go by levels.
ONE_TASK = 200_000


def valid(bookings: DataFrame) -> DataFrame:
    """Complete and not deleted."""
    return bookings.where("days is not null and query is not null and bk_id is not null and amount is not null and not coalesce(del, false)")


def booking_buckets(matched: DataFrame, key: list[str], day: str = "day", amount: str = "amount", mode: str = "exact", people: DataFrame | None = None) -> DataFrame:
    """day, ands, amount: the inventory of each day cut by which bookings it serves; without bookings and empty ones go.

    matched: one row for each inventory key, day and booking that it fits (bk_id), with the key's amount. The distinct
    sets of bookings that occur are the non-zero pieces of the partition, whatever their number. mode "tbr" takes
    behaviour into account: what all of a set's bookings fit, times the share of its people who have all their
    behaviours, less what other bookings fit of it, times the mean share of the sets that are one booking larger,
    weighted by their inventory. people: fits and has (arrays of bookings that some people fit, and of those whose
    behaviour they have) and n.
    """
    signature = matched.groupBy(day, *key).agg(F.sort_array(F.collect_set("bk_id")).alias("ands"), F.first(amount).alias("_n"))
    exact = signature.groupBy(day, "ands").agg(F.sum("_n").alias(amount)).where(F.col(amount) > 0)
    if mode == "exact":
        return exact
    exact = written(exact.select(F.col(day).alias("day"), "ands", F.col(amount).alias("n")), "exact-buckets")
    # every set, and every set with one booking more of those that stand with it
    wide = exact.select("day", F.col("ands").alias("set"), F.explode("ands").alias("member"), "n")
    sets = exact.select("day", "ands")
    held = sets.withColumn("member", F.col("ands")[0]).join(wide, ["day", "member"]).where(F.size(F.array_except("ands", "set")) == 0)
    whole = held.groupBy("day", "ands").agg(F.sum("n").alias("p"))
    more = held.select("day", "ands", F.explode(F.array_except("set", "ands")).alias("other"), "n").groupBy("day", "ands", "other").agg(F.sum("n").alias("q"))
    more = more.withColumn("with", F.array_sort(F.array_union("ands", F.array("other"))))
    shares = written(_set_shares(sets.select("ands").union(more.select("with")).distinct(), people), "set-shares")
    others = more.join(shares.withColumnRenamed("ands", "with"), "with").groupBy("day", "ands").agg((F.sum(F.col("q") * F.col("t")) / F.sum("q")).alias("mean"))
    joined = exact.join(whole, ["day", "ands"]).join(shares, "ands").join(others, ["day", "ands"], "left")
    n = F.col("p") * F.col("t") - (F.col("p") - F.col("n")) * F.coalesce("mean", F.lit(0.0))
    return joined.select(F.col("day").alias(day), "ands", F.when(F.col("t") > 0, n).otherwise(0.0).cast("long").alias(amount)).where(F.col(amount) > 0)


def _set_shares(sets: DataFrame, people: DataFrame) -> DataFrame:
    """ands, t: of the people whom all of a set's bookings fit, the share who have all their behaviours."""
    known = people.select(F.monotonically_increasing_id().alias("who"), "fits", "has", "n")
    known = written(known, "people").withColumn("member", F.explode("fits"))
    met = sets.withColumn("member", F.col("ands")[0]).join(known, "member").where(F.size(F.array_except("ands", "fits")) == 0)
    has = F.when(F.size(F.array_except("ands", "has")) == 0, F.col("n")).otherwise(0)
    sums = met.groupBy("ands").agg(F.sum(has).cast("double").alias("x"), F.sum("n").cast("double").alias("y"))
    joined = sets.join(sums, "ands", "left")
    return joined.select("ands", F.coalesce(behaviour_ratio(F.col("x"), F.col("y")), F.lit(0.0)).alias("t"))


def components(buckets: DataFrame, by_day: bool = True) -> DataFrame:
    """buckets (day, ands, amount) with `component`: those that share bookings, directly or through others, on one day or on any."""
    name = (lambda x: F.concat_ws("/", "day", x)) if by_day else (lambda x: x)
    edges = buckets.select(F.explode("ands").alias("x"), "day", F.col("ands")[0].alias("y")).select(name(F.col("x")).alias("u"), name(F.col("y")).alias("v"))
    return buckets.withColumn("node", name(F.col("ands")[0])).join(connected_components(edges), "node").drop("node")


def hwm_allocate(buckets: DataFrame, demand: DataFrame, scope: str = "day", one_task: int = ONE_TASK) -> DataFrame:
    """day, ands, amount, bk_id, allocated: bookings in order take an equal share of what their buckets have left.

    buckets: day, ands, amount. demand: bk_id, rank, per_day (what a booking wants on each of its days), days. Day by
    day, a booking takes per_day / remaining (1 at most) of every bucket of the day that serves it, rounded to whole
    impressions. scope: remaining is what its buckets of that `day` have left, or those of `all_days`. Buckets that
    share no booking are independent. A component of at most one_task rows is one group; larger ones are served by
    levels: bookings of a day that share no bucket take their turn in the same round, so there are as many rounds as the
    longest chain of bookings of which each shares a bucket with the next (for all_days, on each day).
    """
    buckets = written(buckets, "buckets")
    wanted = demand.select("bk_id", "rank", "per_day", F.explode("days").alias("day"))
    held = components(buckets, scope == "day").withColumn("bk_id", F.explode("ands")).join(wanted, ["day", "bk_id"])
    rows = written(held.withColumn("ands", F.array_join("ands", "|")), "booking-rows")
    keys = ["day", "component"] if scope == "day" else ["component"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    sized = rows.join(sizes, keys)

    def allocate(rows: pd.DataFrame) -> pd.DataFrame:
        rows, bucket, amounts, turns = _in_turns(rows, ["day", "rank", "bk_id"])
        left, allocated, own = amounts.astype(float), np.zeros(len(rows), np.int64), {}
        if scope == "all_days":
            own = {b: bucket[at] for b, at in rows.groupby("bk_id").indices.items()}
        for start, stop in turns:
            at = bucket[start:stop]
            remaining = left[own[rows["bk_id"].iat[start]] if own else at].sum()
            share = min(rows["per_day"].iat[start] / remaining, 1.0) if remaining > 0 else 0.0
            allocated[start:stop] = np.floor(left[at] * share + 0.5)
            left[at] -= allocated[start:stop]
        return rows.assign(allocated=allocated)[["day", "ands", "amount", "bk_id", "allocated"]]

    columns = "day string, ands string, amount long, bk_id string, allocated long"
    small = sized.where(f"rows <= {one_task}").groupBy(*keys).applyInPandas(allocate, columns)
    large = written(sized.where(f"rows > {one_task}").drop("rows"), "large-components")
    return small.union(_hwm_by_levels(large, scope)) if large.limit(1).count() else small


def _in_turns(rows: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The rows of a component in order of turns; each row's bucket's number; the buckets' amounts; where turns begin and end."""
    rows = rows.sort_values([*order, "ands"]).reset_index(drop=True)
    bucket, _ = pd.factorize(pd.MultiIndex.from_frame(rows[["day", "ands"]]))
    amounts = np.zeros(bucket.max() + 1, np.int64)
    amounts[bucket] = rows["amount"]
    begins = np.flatnonzero((rows[order] != rows[order].shift()).any(axis=1))
    return rows, bucket, amounts, list(zip(begins, [*begins[1:], len(rows)]))


def _hwm_by_levels(rows: DataFrame, scope: str) -> DataFrame:
    """hwm_allocate of large components, in rounds of bookings that don't meet; the tables stay distributed."""
    placed, levels = placed_by_level(rows, ["day", "ands"], ["day", "bk_id"], ["rank", "bk_id"])
    found = "day", "ands", "amount", "bk_id", F.col("taken").alias("allocated")
    share = F.when(F.col("remaining") > 0, F.least(F.col("per_day") / F.col("remaining"), F.lit(1.0))).otherwise(0.0)
    taken = F.floor(F.col("left") * share + 0.5).cast("long")

    def of_day(now: DataFrame) -> DataFrame:
        remaining = now.groupBy("day", "bk_id").agg(F.sum("left").cast("double").alias("remaining"))
        return now.join(remaining, ["day", "bk_id"]).withColumn("taken", taken).drop("remaining")

    if scope == "day":
        return served_by_level(placed, levels, ["day", "ands"], "amount", of_day).select(*found)

    # day after day; what a booking's buckets of all days had left in the morning, less what is gone of the day's own
    pool = written(rows.groupBy("bk_id").agg(F.sum("amount").alias("pool")), "pool")
    days = placed.groupBy("day").agg(F.max("level").alias("levels")).orderBy("day").collect()  # one row a day
    each = []
    for day, levels in days:
        own = placed.where(F.col("day") == day)

        def of_all_days(now: DataFrame, pool: DataFrame = pool) -> DataFrame:
            gone = now.groupBy("bk_id").agg(F.sum(F.col("amount") - F.col("left")).alias("gone")).join(pool, "bk_id")
            return now.join(gone, "bk_id").withColumn("remaining", (F.col("pool") - F.col("gone")).cast("double")).withColumn("taken", taken).drop("remaining", "pool", "gone")

        each.append(served_by_level(own, levels, ["day", "ands"], "amount", of_all_days).select(*found))
        of_bucket = each[-1].groupBy("ands").agg(F.sum("allocated").alias("n"))
        spent = own.select("ands", "bk_id").join(of_bucket, "ands").groupBy("bk_id").agg(F.sum("n").alias("spent"))
        pool = written(pool.join(spent, "bk_id", "left").select("bk_id", (F.col("pool") - F.coalesce("spent", F.lit(0))).alias("pool")), "pool")
    return reduce(DataFrame.union, each)


def hwm_resources(keys: DataFrame, allocated: DataFrame) -> DataFrame:
    """day, ands, key, bk_id, allocated: each bucket's allocations shared out over its keys in proportion to what they have.

    keys: day, ands (joined by |), key, n. A booking's whole number is cut at the running shares of the keys in key
    order, so the keys' numbers add up to it and none gets over its rounded-up share.
    """
    sums = keys.groupBy("day", "ands").agg(F.sum("n").alias("total"))
    shares = running_sum(keys, ["day", "ands"], ["key"], "n", "upto").join(sums, ["day", "ands"])
    j = allocated.where("allocated > 0").select("day", "ands", "bk_id", "allocated").join(shares, ["day", "ands"])
    cut = lambda x: F.floor(F.col("allocated") * x / F.col("total"))
    return j.select("day", "ands", "key", "bk_id", (cut(F.col("upto")) - cut(F.col("upto") - F.col("n"))).cast("long").alias("allocated"))


def allocate_batch(buckets: DataFrame, requests: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """day, ands, request, booked: requests (request, rank, wanted, day) served in order from the buckets that name them.

    A request takes what it still wants from its buckets, those that serve fewest others first, and leaves the rest.
    Components of over one_task rows are served by levels, as in hwm_allocate.
    """
    buckets = written(buckets, "buckets")
    held = components(buckets).withColumn("request", F.explode("ands")).join(requests, ["day", "request"])
    rows = written(held.withColumn("width", F.size("ands")).withColumn("ands", F.array_join("ands", "|")), "request-rows")
    keys = ["day", "component"]
    sized = rows.join(rows.groupBy(*keys).agg(F.count("*").alias("rows")), keys)

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        rows, bucket, left, turns = _in_turns(rows, ["rank", "request", "width"])
        booked = np.zeros(len(rows), np.int64)
        wanted = dict(zip(rows["request"], rows["wanted"]))
        for start, stop in turns:  # a request's buckets of one width
            at, request = bucket[start:stop], rows["request"].iat[start]
            upto = np.cumsum(left[at])
            booked[start:stop] = np.clip(wanted[request] - upto + left[at], 0, left[at])
            left[at] -= booked[start:stop]
            wanted[request] -= booked[start:stop].sum()
        return rows.assign(booked=booked)[["day", "ands", "request", "booked"]][booked > 0]

    columns = "day string, ands string, request string, booked long"
    small = sized.where(f"rows <= {one_task}").groupBy(*keys).applyInPandas(serve, columns)
    large = written(sized.where(f"rows > {one_task}").drop("rows"), "large-components")
    return small.union(_batch_by_levels(large)) if large.limit(1).count() else small


def _batch_by_levels(rows: DataFrame) -> DataFrame:
    """allocate_batch of large components, in rounds of requests that don't meet; running sums say what each takes."""
    placed, levels = placed_by_level(rows, ["day", "ands"], ["day", "request"], ["rank", "request"])

    def serve(now: DataFrame) -> DataFrame:
        upto = running_sum(now, ["day", "request"], ["width", "ands"], "left", "upto")
        taken = F.greatest(F.least("left", F.col("wanted") - F.col("upto") + F.col("left")), F.lit(0))
        return upto.withColumn("taken", taken.cast("long")).drop("upto")

    served = served_by_level(placed, levels, ["day", "ands"], "amount", serve)
    return served.where("taken > 0").select("day", "ands", "request", F.col("taken").alias("booked"))


def replace_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, marked deleted on the days that new has, and new."""
    days = new.select("day").distinct().withColumn("_new", F.lit(True))
    marked = old.join(days, "day", "left").select(*old.columns, F.coalesce("_new", F.lit(False)).alias("del"))
    return marked.unionByName(new.withColumn("del", F.lit(False)))
