"""Operators over tables of series: cleaning, clustering of sparse keys, distribution, features, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions import series as Z


def is_sparse(popularity: Column, ts: Column, share: float, least: float) -> Column:
    """Not dense: dense series have over `share` of their points non-zero and a popularity of `least` or more."""
    return ~((F.size(Z.nonzero(ts)) > share * F.size(ts)) & (popularity >= least))


def without_weak(df: DataFrame, popularity: float, share: float) -> DataFrame:
    """Series over the popularity, and with at least that share of non-zero points; imp and p are added."""
    ts = F.col("ts")
    out = df.withColumn("imp", Z.total(ts)).withColumn("p", Z.popularity(ts))
    return out.where((F.col("p") > popularity) & ~(F.size(Z.nonzero(ts)) < share * F.size("ts")))


def daily_counts(fact: DataFrame, keys: Sequence[str] = ("uckey", "price_cat"), day: str = "day", count: str = "cnt") -> DataFrame:
    return fact.groupBy(*keys, day).agg(F.sum(count).alias("count"))


def collected_series(counts: DataFrame, days: Column, keys: Sequence[str] = ("uckey", "price_cat"), day: str = "day") -> DataFrame:
    """keys and ts over `days`, an array column of the values of `day`."""
    m = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(day, "count"))).alias("m"))
    return m.withColumn("days", days).select(*keys, Z.densified(F.col("m"), F.col("days")).alias("ts"))


def index_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pos, total): sums over all series at each position."""
    return df.select(*keys, F.posexplode("ts").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum(F.coalesce("x", F.lit(0))).alias("total"))


def global_outlier_fix(df: DataFrame, half_window: int = 5, sigmas: float = 6.0) -> DataFrame:
    """Where the totals over all series are outliers, a point with both neighbours becomes their mean, left to right."""
    totals = index_totals(df).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda s: s["total"].cast("double")).alias("ts"))  # one row of one value a day
    seen = totals.select("ts", Z.hampel(F.col("ts"), half_window, sigmas)["ts"].alias("fixed")).select(F.zip_with("ts", "fixed", lambda a, b: a != b).alias("out"))
    mend = F.aggregate(
        F.sequence(F.lit(0), F.size("ts") - 1), F.struct(F.array().cast("array<double>").alias("done")),
        lambda s, i: F.struct(F.concat(s["done"], F.array(F.when(
            F.try_element_at("out", i + 1) & (i > 0) & (i < F.size("ts") - 1) & F.try_element_at(s["done"], i).isNotNull() & F.try_element_at("ts", i + 1).isNotNull() & F.try_element_at("ts", i + 2).isNotNull(),
            (F.try_element_at(s["done"], i) + F.try_element_at("ts", i + 2)) / 2).otherwise(F.try_element_at("ts", i + 1).cast("double")))).alias("done")),
    )["done"]
    joined = df.crossJoin(F.broadcast(seen)).withColumn("ts", F.when(F.size("ts") > 0, F.col("ts").cast("array<double>")).otherwise(F.array().cast("array<double>")))
    return joined.withColumn("ts", F.when(F.size("ts") > 0, mend).otherwise(F.col("ts"))).drop("out")


def cluster_sparse(df: DataFrame, clusters: int, sparse_share: float, dense_least: float) -> DataFrame:
    """Virtual clusters of sparse series: cluster_uckey, price_cat, members, imp, ts, and each slot's share by map `si`.

    A sparse key joins one of `clusters` groups of its slot by a hash of the key, so the same key joins the same group
    on any run; a dense key is a cluster of its own. df: uckey, price_cat, ts.
    """
    ts = F.col("ts")
    told = df.withColumn("imp", Z.total(ts)).withColumn("sparse", is_sparse(Z.popularity(ts), ts, sparse_share, dense_least))
    slot = K.part(F.col("uckey"), 1)
    group = F.when(F.col("sparse"), F.concat(slot, F.lit("/"), F.pmod(K.sha256_bucket(F.col("uckey"), 1 << 20), F.lit(clusters)).cast("string"))).otherwise(F.col("uckey"))
    keyed = told.select(group.alias("cluster_uckey"), "price_cat", "uckey", "imp", "sparse", slot.alias("slot"), "ts")
    points = keyed.select("cluster_uckey", "price_cat", F.posexplode("ts").alias("pos", "x")).groupBy("cluster_uckey", "price_cat", "pos").agg(F.sum(F.coalesce("x", F.lit(0))).alias("x"))
    sums = points.groupBy("cluster_uckey", "price_cat").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("ts"))
    heads = keyed.groupBy("cluster_uckey", "price_cat").agg(F.count("*").alias("members"), F.sum("imp").alias("imp"), F.bool_or("sparse").alias("sparse"))
    return heads.join(sums, ["cluster_uckey", "price_cat"])


def cluster_of(df: DataFrame, clusters: int, sparse_share: float, dense_least: float) -> DataFrame:
    """uckey, price_cat, cluster_uckey, imp of every series, by the same rule as cluster_sparse."""
    ts = F.col("ts")
    slot = K.part(F.col("uckey"), 1)
    group = F.concat(slot, F.lit("/"), F.pmod(K.sha256_bucket(F.col("uckey"), 1 << 20), F.lit(clusters)).cast("string"))
    return df.select("uckey", "price_cat", F.when(is_sparse(Z.popularity(ts), ts, sparse_share, dense_least), group).otherwise(F.col("uckey")).alias("cluster_uckey"), Z.total(ts).alias("imp"))


def distribution(members: DataFrame) -> DataFrame:
    """uckey, price_cat, cluster_uckey, ratio: a member's share of its cluster's impressions, 1.0 for a lone key.

    A shuffled join of sums rather than a window: sums are combined before the shuffle, so a large cluster costs no more.
    """
    sums = members.groupBy("cluster_uckey", "price_cat").agg(F.sum("imp").alias("cluster_imp"), F.count("*").alias("n"))
    j = members.join(sums, ["cluster_uckey", "price_cat"])
    return j.select("uckey", "price_cat", "cluster_uckey", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.coalesce(F.col("imp") / F.nullif(F.col("cluster_imp"), F.lit(0)), F.lit(0.0))).alias("ratio"))


def redistributed(predictions: DataFrame, ratios: DataFrame) -> DataFrame:
    """(uckey, price_cat, pos, value) from cluster forecasts (cluster_uckey, price_cat, ts) and members' ratios."""
    return ratios.join(predictions, ["cluster_uckey", "price_cat"]).select("uckey", "price_cat", "ratio", F.posexplode("ts").alias("pos", "x")).select("uckey", "price_cat", "pos", (F.coalesce("x", F.lit(0)) * F.col("ratio")).alias("value"))


def zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <column>_n = (x - mean) / sample deviation; a deviation of 0 or null counts as 1. One pass for all columns."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"{c}_n") for c in columns])


def compared(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of both series and the number of positions that differ, for every key of either."""
    x, y = a.select(*keys, F.col("ts").alias("x")), b.select(*keys, F.col("ts").alias("y"))
    differ = F.size(F.filter(F.zip_with(F.coalesce("x", F.array().cast("array<long>")), F.coalesce("y", F.array().cast("array<long>")), lambda p, q: ~p.eqNullSafe(q)), lambda d: d))
    zero = F.lit(0).cast("long")
    return x.join(y, list(keys), "full").select(*keys, F.coalesce(Z.total(F.col("x")), zero).alias("total_a"), F.coalesce(Z.total(F.col("y")), zero).alias("total_b"), differ.alias("points_differ"))


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, into: str, descending: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.sum(value).over(w))
