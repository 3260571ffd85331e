"""Section 2.11, traffic: facts, series, clusters, forecasts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import amounts as M
from tidemark.functions import keys as K
from tidemark.functions import series as Z
from tidemark.operators import series as S
from tidemark.operators import tables as T
from tidemark.plans.columns import _AP, actual_predicted
from tidemark.plans.filters import IMP, NONZERO
from tidemark.plans.inputs import FACT_SQL, SERIES_SQL, YEARS, fact, series, text_of
from tidemark.plans.joins import MEMBERS_SQL, members
from tidemark.plans.registry import query
from tidemark.plans.scans import BUCKET_SQL

_KEY = "uckey, price_cat"


@query(f"""
WITH {FACT_SQL} SELECT uckey, '1:' || CAST(sum(cnt) AS BIGINT) AS count_array, 0 AS hour, strftime(day, '%Y-%m-%d') AS day,
  {BUCKET_SQL.format('uckey', 10)} AS bucket_id
FROM fact GROUP BY uckey, fact.day""")
def request_to_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request totals of a day as fact rows: a count array with the default price, the default hour, a bucket."""
    total = fact(spark, sf_dir).groupBy("uckey", "day").agg(F.sum("cnt").alias("total"))
    array = F.array(F.concat(F.lit("1:"), F.col("total").cast("string")))
    return total.select("uckey", F.array_join(array, ",").alias("count_array"), F.lit(0).alias("hour"), F.date_format("day", "yyyy-MM-dd").alias("day"), K.sha256_bucket(F.col("uckey"), 10).alias("bucket_id"))


@query(f"WITH {FACT_SQL}, b AS (SELECT regexp_replace(uckey, '^((?:[^,]*,){{6}})[^,]*', '\\1') AS uckey, day, cnt FROM fact WHERE split_part(uckey, ',', 2) IN ('slot0', 'slot2')) SELECT uckey, day, CAST(sum(cnt) AS BIGINT) AS n, {BUCKET_SQL.format('uckey', 10)} AS bucket_id FROM b GROUP BY uckey, day")
def sanitize_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fact(spark, sf_dir).where(K.part(F.col("uckey"), 1).isin("slot0", "slot2")).withColumn("uckey", K.blank_part(F.col("uckey"), 6))
    return f.groupBy("uckey", "day").agg(F.sum("cnt").alias("n")).withColumn("bucket_id", K.sha256_bucket(F.col("uckey"), 10))


@query(f"""
WITH {SERIES_SQL} SELECT {_KEY}, array_to_string(list_transform(ts[1:5], lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS ts,
  array_to_string(list_transform(ts[6:7], lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS ts_ver, split_part(uckey, ',', 5) AS a,
  split_part(uckey, ',', 4) AS g, split_part(uckey, ',', 3) AS t, split_part(uckey, ',', 2) AS si, split_part(uckey, ',', 7) AS r,
  {BUCKET_SQL.format('uckey', 10)} AS bucket_id, CAST(coalesce(list_sum(ts[1:5]), 0) AS BIGINT) AS imp,
  NOT (len(list_filter(ts[1:5], lambda x: x <> 0)) > 2.5 AND coalesce(list_sum(ts[1:5]), 0) / 5.0 >= 10) AS sparse
FROM series""")
def build_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows to a series of past years and one of the years after, the key's parts, bucket, total and density."""
    counts = S.daily_counts(fact(spark, sf_dir).withColumn("y", F.year("day")), day="y")
    s = S.collected_series(counts, F.array(*[F.lit(y) for y in YEARS]), day="y")
    past, after, k = F.slice("ts", 1, 5), F.slice("ts", 6, 2), F.col("uckey")
    s = s.select("uckey", "price_cat", past.alias("ts"), after.alias("ts_ver"))
    parts = [K.part(k, i).alias(n) for i, n in ((4, "a"), (3, "g"), (2, "t"), (1, "si"), (6, "r"))]
    return s.select("uckey", "price_cat", text_of("ts").alias("ts"), text_of("ts_ver").alias("ts_ver"), *parts, K.sha256_bucket(k, 10).alias("bucket_id"), Z.total(F.col("ts")).alias("imp"), S.is_sparse(Z.popularity(F.col("ts")), F.col("ts"), 0.5, 10.0).alias("sparse"))


_GROUP = f"""
CASE WHEN NOT ({NONZERO} > 3.5 AND {IMP} / 7.0 >= 20) THEN split_part(uckey, ',',
  2) || '/' || ({BUCKET_SQL.format('uckey', 1 << 20)} % 6) ELSE uckey END"""


@query(f"""
WITH {SERIES_SQL},
g AS (SELECT {_GROUP} AS cluster_uckey, price_cat, ts, {IMP} AS imp
FROM series),
x AS (SELECT cluster_uckey, price_cat, unnest(range(7)) AS pos, coalesce(unnest(ts), 0) AS n
FROM g),
s AS (SELECT cluster_uckey, price_cat, pos, CAST(sum(n) AS BIGINT) AS n
FROM x GROUP BY ALL),
t AS (SELECT cluster_uckey, price_cat, string_agg(CAST(n AS VARCHAR), ',' ORDER BY pos) AS ts
FROM s GROUP BY ALL),
h AS (SELECT cluster_uckey, price_cat, count(*) AS members, CAST(sum(imp) AS BIGINT) AS imp
FROM g GROUP BY ALL) SELECT h.cluster_uckey, h.price_cat, members, imp, ts
FROM h JOIN t ON h.cluster_uckey = t.cluster_uckey AND h.price_cat = t.price_cat""")
def cluster_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.cluster_sparse(series(spark, sf_dir), 6, 0.5, 20.0)
    return c.select("cluster_uckey", "price_cat", "members", "imp", text_of("ts").alias("ts"))


@query(f"""
WITH {SERIES_SQL},
g AS (SELECT {_KEY}, {_GROUP} AS cluster_uckey, {IMP} AS imp
FROM series) SELECT {_KEY}, cluster_uckey, round(CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE coalesce(imp / nullif(CAST(sum(imp) OVER w AS DOUBLE),
  0), 0) END, 9) AS ratio
FROM g WINDOW w AS (PARTITION BY cluster_uckey, price_cat)""")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.distribution(S.cluster_of(series(spark, sf_dir), 6, 0.5, 20.0))
    return d.withColumn("ratio", F.round("ratio", 9))


@query(f"""
WITH {SERIES_SQL},
f AS (SELECT {_KEY}, CASE WHEN split_part(uckey, ',', 4) = 'F' THEN 1.0 ELSE 0 END AS g_f, CASE WHEN split_part(uckey, ',',
  3) = 'O' THEN 1.0 ELSE 0 END AS t_o, {IMP} / 7.0 AS p, list_sum(list_transform(ts, lambda x: ln(1 + coalesce(x, 0)))) AS l
FROM series),
s AS (SELECT avg(g_f) AS a, stddev_samp(g_f) AS b, avg(t_o) AS c, stddev_samp(t_o) AS d, avg(p) AS e, stddev_samp(p) AS f
FROM f) SELECT uckey || '-' || price_cat AS page_ix, round(CAST((g_f - a) / b AS DOUBLE), 6) AS g_f_n, round(CAST((t_o - c) / d AS DOUBLE),
  6) AS t_o_n, round(CAST((p - e) / s.f AS DOUBLE), 6) AS p_n, round(l, 6) AS log_sum
FROM f, s""")
def normalize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("uckey"), F.col("ts")
    log_sum = F.aggregate(Z.log_series(ts), F.lit(0.0), lambda a, x: a + x)
    f = series(spark, sf_dir).select(F.concat_ws("-", "uckey", "price_cat").alias("page_ix"), (K.part(k, 3) == "F").cast("int").alias("g_f"), (K.part(k, 2) == "O").cast("int").alias("t_o"), Z.popularity(ts).alias("p"), log_sum.alias("log_sum"))
    z = S.zscores(f, ["g_f", "t_o", "p"])
    return z.select("page_ix", *[F.round(c, 6).alias(c) for c in ("g_f_n", "t_o_n", "p_n", "log_sum")])


@query(f"""
WITH {SERIES_SQL} SELECT {_KEY}, round(CAST(greatest(coalesce(ts[7], 0) + 0.5 * (coalesce(ts[7], 0) - coalesce(ts[6], 0)), 0) AS DOUBLE), 4) AS score
FROM series""")
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.scoring import scored, trend

    s = series(spark, sf_dir).withColumn("ts", Z.zero_filled(F.col("ts")))
    return scored(s, ["uckey", "price_cat"], trend).select("uckey", "price_cat", F.round("score", 4).alias("score"))


@query(f"""
WITH {MEMBERS_SQL},
x AS (SELECT cluster_uckey, price_cat, unnest(range(7)) AS pos, coalesce(unnest(ts), 0) AS n
FROM members),
c AS (SELECT cluster_uckey, price_cat, pos, sum(n) AS n
FROM x GROUP BY ALL) SELECT d.uckey, d.price_cat, CAST(pos AS INT) AS pos, round(CAST(n * ratio AS DOUBLE), 4) AS value
FROM dist d JOIN c ON d.cluster_uckey = c.cluster_uckey AND d.price_cat = c.price_cat""")
def redistribute_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    points = S.index_totals(m, ["cluster_uckey", "price_cat"])
    forecast = points.groupBy("cluster_uckey", "price_cat").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda s: s["total"]).alias("ts"))
    return S.redistributed(forecast, S.distribution(m.drop("ts"))).select("uckey", "price_cat", "pos", F.round("value", 4).alias("value"))


@query(f"""
WITH {_AP},
s AS (SELECT split_part(uckey, ',', 2) AS si, sum(actual) AS actual, sum(predicted) AS predicted, count(*) AS keys,
  count(*) FILTER (actual > 30) AS dense
FROM ap GROUP BY 1),
e AS (SELECT *, CASE WHEN actual = 0 THEN -1 ELSE round(abs(actual - predicted) / actual, 3) END AS error
FROM s) SELECT si, CAST(actual AS BIGINT) AS actual, CAST(predicted AS BIGINT) AS predicted, error, round(dense / CAST(keys AS DOUBLE),
  6) AS dense_ratio, round(sum(error * actual) OVER () / sum(actual) OVER (), 6) AS by_traffic, round(sum(error * keys) OVER () / sum(keys) OVER (),
  6) AS by_keys
FROM e""")
def prediction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots' errors, and the totals weighted by traffic and by keys. Windows run over one row a slot."""
    s = actual_predicted(spark, sf_dir).groupBy(K.part(F.col("uckey"), 1).alias("si")).agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.count("*").alias("keys"), F.count_if(F.col("actual") > 30).alias("dense"))
    e = s.withColumn("error", M.relative_error(F.col("actual"), F.col("predicted")))
    w = Window.partitionBy(F.lit(0))
    weighted = lambda by: F.round(F.sum(F.col("error") * F.col(by)).over(w) / F.sum(by).over(w), 6)
    return e.select("si", F.col("actual").cast("long").alias("actual"), F.col("predicted").cast("long").alias("predicted"), "error", F.round(F.col("dense") / F.col("keys"), 6).alias("dense_ratio"), weighted("actual").alias("by_traffic"), weighted("keys").alias("by_keys"))


@query(f"""
WITH {MEMBERS_SQL},
x AS (SELECT uckey, price_cat, unnest(range(7)) AS pos, coalesce(unnest(ts), 0) AS actual
FROM members WHERE split_part(uckey, ',', 2) IN ('slot1', 'slot2')) SELECT uckey, price_cat, CAST(pos AS INT) AS pos, actual,
  coalesce(lag(actual) OVER (PARTITION BY uckey, price_cat ORDER BY pos), 0) AS predicted
FROM x""")
def prediction_sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year by year for some slots, the year before as the forecast: arrays zipped and exploded."""
    s = series(spark, sf_dir).where(K.part(F.col("uckey"), 1).isin("slot1", "slot2"))
    zeros = Z.zero_filled(F.col("ts"))
    both = F.arrays_zip(zeros.alias("actual"), F.concat(F.array(F.lit(0).cast("long")), F.slice(zeros, 1, 6)).alias("predicted"))
    return s.select("uckey", "price_cat", F.posexplode(both).alias("pos", "x")).select("uckey", "price_cat", "pos", F.col("x").getField("actual").alias("actual"), F.col("x").getField("predicted").alias("predicted"))


@query(f"""
WITH {SERIES_SQL},
b AS (SELECT {_KEY}, list_transform(ts, lambda x: CASE WHEN x > 60 THEN NULL ELSE x END) AS ts
FROM series WHERE price_cat <> '2'),
z AS (SELECT a.uckey, a.price_cat, {IMP.replace('ts', 'a.ts')} AS total_a,
  CASE WHEN b.uckey IS NULL THEN 0 ELSE {IMP.replace('ts', 'b.ts')} END AS total_b,
  CASE WHEN b.uckey IS NULL THEN {NONZERO.replace('ts', 'a.ts')} ELSE len(list_filter(range(1, 8),
  lambda i: a.ts[i] IS DISTINCT FROM b.ts[i])) END AS points_differ
FROM series a LEFT JOIN b ON a.uckey = b.uckey AND a.price_cat = b.price_cat) SELECT uckey, price_cat, total_a, total_b,
  CAST(points_differ AS INT) AS points_differ
FROM z""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    other = s.where("price_cat <> '2'").withColumn("ts", F.transform("ts", lambda x: F.when(x > 60, F.lit(None).cast("long")).otherwise(x)))
    return S.compared(s, other, ["uckey", "price_cat"])


@query(f"""
WITH {FACT_SQL} SELECT CAST(sum(cnt) AS BIGINT) AS impressions
FROM fact WHERE split_part(uckey, ',', 2) = 'slot2' AND split_part(uckey, ',', 4) = 'O' AND year(day) = 1998""")
def impression_of_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("uckey")
    named = fact(spark, sf_dir).select(K.part(k, 1).alias("si"), K.part(k, 3).alias("g"), F.year("day").alias("day"), "cnt")
    return T.with_attributes(named, {"si": "slot2", "g": "O", "day": 1998}).agg(F.sum("cnt").alias("impressions"))


@query(f"WITH {SERIES_SQL} SELECT split_part(uckey, ',', 2) AS si, CAST(sum(ts[4]) AS BIGINT) AS n FROM series GROUP BY 1")
def slot_day_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy(K.part(F.col("uckey"), 1).alias("si")).agg(F.sum(F.try_element_at("ts", F.lit(4))).alias("n"))


@query(f"""
WITH {MEMBERS_SQL},
x AS (SELECT m.uckey, unnest(range(7)) AS pos, coalesce(unnest(ts), 0) * ratio AS n
FROM members m JOIN dist d ON m.uckey = d.uckey AND m.price_cat = d.price_cat) SELECT uckey, CAST(1995 + pos AS VARCHAR) AS day,
  round(CAST(sum(n) AS DOUBLE), 4) AS impr
FROM x GROUP BY ALL""")
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    j = m.join(S.distribution(m.drop("ts")).select("uckey", "price_cat", "ratio"), ["uckey", "price_cat"])
    x = j.select("uckey", "ratio", F.posexplode("ts").alias("pos", "n"))
    return x.groupBy("uckey", (F.col("pos") + 1995).cast("string").alias("day")).agg(F.round(F.sum(F.coalesce("n", F.lit(0)) * F.col("ratio")), 4).alias("impr"))


@query(f"""
WITH {_AP} SELECT round(avg(abs(actual - predicted) / actual), 6) AS error, round(avg(abs(actual - 0.5 * (actual + predicted)) / actual),
  6) AS other_error, count(*) AS n
FROM ap WHERE actual > 20""")
def model_accuracy_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean relative errors of two scorers over dense keys."""
    from tidemark.operators.scoring import scored

    ap = actual_predicted(spark, sf_dir).where("actual > 20")
    one = scored(ap, ["uckey", "price_cat", "actual", "predicted"], lambda p: p["predicted"])
    two = scored(one, ["actual", "score"], lambda p: 0.5 * (p["actual"] + p["predicted"]), into="other")
    miss = lambda c: F.round(F.avg(F.abs(F.col("actual") - F.col(c)) / F.col("actual")), 6)
    return two.agg(miss("score").alias("error"), miss("other").alias("other_error"), F.count("*").alias("n"))
