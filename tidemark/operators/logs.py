"""Show and click logs: cleaning, timelines, samples, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_of, interval_start
from tidemark.functions.keys import matched_index, sha256_bucket
from tidemark.operators.indexing import running_sum

# Indexes of genders in cleaned logs.
GENDER_INDEX = {"g_f": 1, "g_m": 0}


def clean_persona(persona: DataFrame, key: str = "aid") -> DataFrame:
    """Distinct rows of ids that have one row only."""
    rows = persona.distinct()
    single = rows.groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(key)
    return rows.join(single, key, "left_semi").withColumn("age", F.col("age").cast("int"))


def clean_log(log: DataFrame, persona: DataFrame, keywords: DataFrame, buckets: int, slots: Sequence[str] | None = None) -> DataFrame:
    """Log rows of known users and keywords, with day, gender index and user bucket."""
    rows = log if slots is None else log.where(F.col("slot_id").isin(*slots))
    joined = rows.join(persona, "aid").join(keywords, "spread_app_id")
    return joined.withColumn("day", day_of(F.col("action_time"))).withColumn("gender_index", matched_index(F.col("gender"), GENDER_INDEX, 2)).withColumn("aid_bucket", sha256_bucket(F.col("aid"), buckets))


def union_logs(shows: DataFrame, clicks: DataFrame, step: int | None = None, seconds: str = "sec") -> DataFrame:
    out = shows.withColumn("is_click", F.lit(0)).unionByName(clicks.withColumn("is_click", F.lit(1)))
    return out if step is None else out.withColumn("interval", interval_start(F.col(seconds), step))


def click_show_counts(logs: DataFrame, keys: Sequence[str], all_rows_are_shows: bool = False) -> DataFrame:
    """Clicks and shows of each group; shows count rows that aren't clicks, or all rows."""
    shows = F.count("*") if all_rows_are_shows else F.sum(F.when(F.col("is_click") == 0, 1).otherwise(0))
    return logs.groupBy(*keys).agg(F.sum("is_click").alias("clicks"), shows.alias("shows"))


def drop_unshown(counts: DataFrame) -> DataFrame:
    """Without groups that were never shown."""
    return counts.where("shows > 0")


def timeline(counts: DataFrame, key: str = "aid", interval: str = "interval", item: str = "kwi") -> DataFrame:
    """key, timeline: array of (interval, items), newest first; items: array of (kwi, shows, clicks) by kwi."""
    slots = counts.groupBy(key, interval).agg(F.array_sort(F.collect_list(F.struct(item, "shows", "clicks"))).alias("items"))
    return slots.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(interval, "items")), asc=False).alias("timeline"))


def timeline_text(what: str) -> Column:
    """Each interval's `kwi:<what>` pairs joined by ',', intervals joined by ' '."""
    return F.array_join(F.transform("timeline", lambda s: F.array_join(F.transform(s["items"], lambda i: F.concat_ws(":", i["kwi"].cast("string"), i[what].cast("string"))), ",")), " ")


def training_samples(timelines: DataFrame, cut: int, length: int, key: str = "aid", least: int = 5) -> DataFrame:
    """key, keyword, label, history: a sample for each keyword of an interval at or after `cut`.

    A clicked keyword is a positive; an unclicked one is a negative if its place m in the interval is a multiple of 5
    and the interval's place n an even number, both from 0. The history is the keywords of the next `length` (older)
    intervals, longer than `least` and padded with 0 to a common length by whoever reads it.
    """
    each = timelines.select(key, "timeline", F.posexplode("timeline").alias("n", "slot")).where(F.col("slot.interval") >= cut)
    items = each.select(key, "n", F.expr(f"flatten(transform(slice(timeline, n + 2, {length}), s -> transform(s.items, i -> i.kwi)))").alias("history"), F.posexplode("slot.items").alias("m", "item"))
    kept = items.where((F.col("item.clicks") > 0) | ((F.col("m") % 5 == 0) & (F.col("n") % 2 == 0)))
    return kept.where(F.size("history") > least).select(key, F.col("item.kwi").alias("keyword"), F.when(F.col("item.clicks") > 0, 1).otherwise(0).alias("label"), "history")


def rates(logs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ctr: clicks / shows of each group, 0 without shows."""
    return click_show_counts(logs, keys).withColumn("ctr", F.coalesce(F.col("clicks") / F.nullif(F.col("shows"), F.lit(0)), F.lit(0.0)))


def cumulative_share(rows: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """rows with `into`: the share of the key's rows that stand no later in `order`; rows of one value have one share.

    Counts of each value are summed up, so a hot key isn't sorted in one task.
    """
    counts = rows.groupBy(key, order).agg(F.count("*").alias("_c"))
    sums = counts.groupBy(key).agg(F.sum("_c").alias("_all"))
    upto = running_sum(counts, [key], [order], "_c", "_upto").alias("x").join(sums.alias("y"), F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")))
    shares = upto.select(F.col(f"x.{key}").alias("_key"), F.col(f"x.{order}").alias("_order"), (F.col("_upto") / F.col("_all")).alias(into))
    return rows.join(shares, rows[key].eqNullSafe(shares["_key"]) & rows[order].eqNullSafe(shares["_order"])).drop("_key", "_order")


def region_of(logs: DataFrame, weights: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's rows dealt to regions in proportion to weights (region, weight), in the order of `order`.

    The cumulative weights are a table of a few rows, held against each row's place in (0, 1].
    """
    upto = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, 0)  # one row a region
    everything = Window.partitionBy(F.lit(0))
    cut = weights.select("region", (F.sum("weight").over(upto) / F.sum("weight").over(everything)).alias("high"))
    cut = cut.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("region")), F.lit(0.0)))
    placed = cumulative_share(logs, key, order, "place")
    return placed.join(F.broadcast(cut), (F.col("place") > F.col("low")) & (F.col("place") <= F.col("high"))).drop("low", "high", "place")


def auc(scored: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from ranks; ties share their mean rank. Null where one class is missing.

    Ranks come from counts of each distinct score, summed over the scores below.
    """
    by = scored.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("rank_sum", F.col("p") * (below + (F.col("n") + 1) / 2))
    sums = ranked.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("rank_sum").alias("r"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*keys, F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def effective_keywords(logs: DataFrame, share: float) -> DataFrame:
    """keyword, n of keywords with more than `share` of all rows."""
    counts = logs.groupBy("keyword").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).where(F.col("n") > share * F.col("total")).select("keyword", "n")
