"""Section 2.4: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series as Z
from tidemark.functions.keys import part
from tidemark.operators import logs as L
from tidemark.operators import series as S
from tidemark.operators.indexing import dense_index
from tidemark.operators.sketches import merged_quantiles, quantile_sketch
from tidemark.plans.filters import H_SUM, IMP, NONZERO, users, USERS_SQL
from tidemark.plans.inputs import BOOKINGS_SQL, FACT_SQL, INVENTORY_SQL, LOGS_SQL, PERSONA_SQL, SERIES_SQL, TBR_SQL, behaviour, bookings, fact, inventory, logs, persona, series, table
from tidemark.plans.registry import query
from tidemark.sources.scratch import written

_C = "CAST(sum(cnt) AS BIGINT)"
COUNTS_SQL = f"""
{LOGS_SQL},
c AS (SELECT aid, sec - sec % 86400 AS interval, kwi, CAST(sum(is_click) AS BIGINT) AS clicks,
  CAST(sum(CASE WHEN is_click = 0 THEN 1 ELSE 0 END) AS BIGINT) AS shows
FROM logs GROUP BY ALL)"""


def daily_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).withColumn("interval", F.col("sec") - F.col("sec") % 86400)


@query(f"WITH {FACT_SQL} SELECT uckey, day, price_cat, {_C} AS n FROM fact GROUP BY ALL")
def agg_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily_counts(fact(spark, sf_dir)).withColumnRenamed("count", "n")


@query(f"""
WITH {FACT_SQL},
d AS (SELECT uckey, price_cat, day, {_C} AS n
FROM fact GROUP BY ALL) SELECT uckey, price_cat, string_agg(strftime(day, '%Y%m%d') || ':' || n, ','
ORDER BY day) AS counts FROM d GROUP BY ALL""")
def agg_collect_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.daily_counts(fact(spark, sf_dir))
    m = d.groupBy("uckey", "price_cat").agg(F.map_from_entries(F.collect_list(F.struct(F.date_format("day", "yyyyMMdd").alias("day"), "count"))).alias("m"))
    return m.select("uckey", "price_cat", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("""
SELECT c_nationkey, string_agg(c_name, '|'
ORDER BY c_name) AS names, string_agg(c_mktsegment, '|'
ORDER BY c_name) AS segments FROM customer
GROUP BY 1""")
def agg_collect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("c_name", "c_mktsegment")))
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(rows.alias("r"))
    return g.select("c_nationkey", F.array_join("r.c_name", "|").alias("names"), F.array_join("r.c_mktsegment", "|").alias("segments"))


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n
FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, round(n / CAST(sum(n) OVER (PARTITION BY c_nationkey) AS DOUBLE), 9) AS share
FROM c""")
def agg_value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return c.join(c.groupBy("c_nationkey").agg(F.sum("n").alias("total")), "c_nationkey").select("c_nationkey", "c_mktsegment", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query(f"""
WITH {SERIES_SQL},
x AS (SELECT split_part(uckey, ',', 2) AS si, unnest(range(7)) AS pos, unnest(ts) AS n
FROM series) SELECT si, CAST(pos AS INT) AS pos, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n
FROM x GROUP BY ALL""")
def agg_vector_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_totals(series(spark, sf_dir).withColumn("si", part(F.col("uckey"), 1)), ["si"]).withColumnRenamed("total", "n")


@query(f"""
WITH {FACT_SQL},
d AS (SELECT uckey, day, price_cat, {_C} AS n
FROM fact GROUP BY ALL) SELECT uckey, day, string_agg(price_cat || ':' || n, ','
ORDER BY price_cat) AS counts FROM d GROUP BY ALL""")
def agg_count_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours' 'price:count' arrays of a key and day, merged by price: exploded, summed, nested once."""
    hours = fact(spark, sf_dir).select("uckey", "day", F.array(F.concat_ws(":", "price_cat", F.col("cnt").cast("string"))).alias("count_array"))
    flat = hours.select("uckey", "day", F.explode("count_array").alias("x")).select("uckey", "day", F.substring_index("x", ":", 1).alias("p"), F.substring_index("x", ":", -1).cast("long").alias("n"))
    sums = flat.groupBy("uckey", "day", "p").agg(F.sum("n").alias("n"))
    return sums.groupBy("uckey", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "n"))), lambda s: F.concat_ws(":", s["p"], s["n"].cast("string"))), ",").alias("counts"))


@query(f"WITH {FACT_SQL} SELECT uckey, {_C} AS n FROM fact GROUP BY 1")
def agg_count_array_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = fact(spark, sf_dir).select("uckey", F.array(F.concat_ws(":", "price_cat", F.col("cnt").cast("string"))).alias("c"))
    each = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.substring_index(x, ":", -1).cast("long"))
    return arrays.groupBy("uckey").agg(F.sum(each).alias("n"))


@query(f"""
WITH {LOGS_SQL},
k AS (SELECT keyword, count(*) AS n FROM logs
GROUP BY 1) SELECT keyword, n, row_number() OVER (ORDER BY keyword) - 1 AS ix
FROM k WHERE n > 0.08 * (SELECT sum(n) FROM k)""")
def agg_keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = L.effective_keywords(logs(spark, sf_dir), 0.08)
    return k.join(dense_index(k, "keyword", first=0, into="ix"), "keyword")


@query(f"WITH {COUNTS_SQL} SELECT * FROM c")
def agg_click_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.click_show_counts(daily_logs(spark, sf_dir), ["aid", "interval", "kwi"])


@query(f"""
WITH {LOGS_SQL} SELECT keyword, sec - sec % 86400 AS interval, CAST(sum(is_click) AS BIGINT) AS clicks, count(*) AS shows
FROM logs GROUP BY ALL""")
def agg_click_show_uckey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.click_show_counts(daily_logs(spark, sf_dir), ["keyword", "interval"], all_rows_are_shows=True)


@query(f"WITH {COUNTS_SQL} SELECT aid, interval, string_agg(kwi || ':' || shows, ',' ORDER BY kwi) AS shows FROM c GROUP BY ALL")
def agg_concat_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.click_show_counts(daily_logs(spark, sf_dir), ["aid", "interval", "kwi"])
    pairs = F.array_sort(F.collect_list(F.struct("kwi", "shows")))
    return c.groupBy("aid", "interval").agg(F.array_join(F.transform(pairs, lambda s: F.concat_ws(":", s["kwi"].cast("string"), s["shows"].cast("string"))), ",").alias("shows"))


@query(f"""
WITH {COUNTS_SQL},
i AS (SELECT aid, interval, string_agg(kwi || ':' || clicks, ',' ORDER BY kwi) AS s
FROM c GROUP BY ALL) SELECT aid, string_agg(interval::VARCHAR, ','
ORDER BY interval DESC) AS intervals, string_agg(s, ' '
ORDER BY interval DESC) AS clicks FROM i GROUP BY aid""")
def agg_user_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.timeline(L.click_show_counts(daily_logs(spark, sf_dir), ["aid", "interval", "kwi"]))
    return t.select("aid", F.array_join(F.transform("timeline", lambda s: s["interval"].cast("string")), ",").alias("intervals"), L.timeline_text("clicks").alias("clicks"))


@query("""
SELECT round(avg(l_quantity), 6) AS q_avg, round(stddev_samp(l_quantity), 6) AS q_std, round(avg(l_extendedprice), 4) AS p_avg,
  round(stddev_samp(l_extendedprice), 4) AS p_std
FROM lineitem""")
def agg_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    std = lambda c: F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0))
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("q_avg"), F.round(std("l_quantity"), 6).alias("q_std"), F.round(F.avg("l_extendedprice"), 4).alias("p_avg"), F.round(std("l_extendedprice"), 4).alias("p_std"))


@query(f"""
WITH {SERIES_SQL},
p AS (SELECT {IMP} / 7.0 AS p, {NONZERO} > 3 AS dense
FROM series) SELECT round(quantile_cont(p, 0.5) FILTER (NOT dense), 6) AS sparse_median, round(quantile_cont(p, 0.5) FILTER (dense),
  6) AS dense_median, count(*) FILTER (NOT dense) AS sparse, count(*) FILTER (dense) AS dense
FROM p""")
def agg_approx_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles, to be held against SQL."""
    ts = F.col("ts")
    p = series(spark, sf_dir).select(Z.popularity(ts).alias("p"), (F.size(Z.nonzero(ts)) > 3).alias("dense"))
    med = lambda c: F.round(Z.middle(F.when(c, F.col("p"))), 6)
    return p.agg(med(~F.col("dense")).alias("sparse_median"), med(F.col("dense")).alias("dense_median"), F.count_if(~F.col("dense")).alias("sparse"), F.count_if(F.col("dense")).alias("dense"))


@query()
def agg_sketched_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same medians by mergeable sketches of bounded size, within one part in 10,000 of the rank."""
    ts = F.col("ts")
    p = series(spark, sf_dir).select(Z.popularity(ts).alias("p"), (F.size(Z.nonzero(ts)) > 3).alias("dense"))
    med = lambda c: F.round(Z.middle(F.when(c, F.col("p")), accuracy=10_000), 6)
    return p.agg(med(~F.col("dense")).alias("sparse_median"), med(F.col("dense")).alias("dense_median"))


@query("SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, true AS within FROM lineitem GROUP BY ALL")
def agg_quantiles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price quartiles by year from sketches that are kept by day, and whether each has its rank within 2 % of the rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"), F.year("l_shipdate").cast("int").alias("year"), F.col("l_extendedprice").alias("price"))
    daily = written(quantile_sketch(rows, ["flag", "year", "day"], "price"), "daily-quantiles")
    ranks = (0.25, 0.5, 0.75)
    found = merged_quantiles(daily, ["flag", "year"], ranks)
    at = F.col("quantiles")
    j = rows.join(found.select("flag", "year", "quantiles"), ["flag", "year"])
    counted = [F.count_if(F.col("price") < at[k]).alias(f"below{k}") for k in range(3)] + [F.count_if(F.col("price") <= at[k]).alias(f"upto{k}") for k in range(3)]
    held = j.groupBy("flag", "year").agg(F.count("*").alias("n"), *counted)
    near = [(F.col(f"below{k}") <= (r + 0.02) * F.col("n") + 1) & (F.col(f"upto{k}") >= (r - 0.02) * F.col("n") - 1) for k, r in enumerate(ranks)]
    return held.select("flag", "year", "n", (near[0] & near[1] & near[2]).alias("within"))


@query(f"""
WITH {SERIES_SQL},
x AS (SELECT unnest(range(7)) AS pos, unnest(ts) AS n
FROM series) SELECT CAST(pos AS INT) AS pos, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total
FROM x GROUP BY ALL""")
def agg_index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_totals(series(spark, sf_dir))


@query(f"WITH {USERS_SQL} SELECT CAST(max(len(kws)) AS INT) AS longest FROM users")
def agg_max_array_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).agg(F.max(F.size("kws")).alias("longest"))


@query(f"""
WITH {SERIES_SQL} SELECT coalesce(split_part(uckey, ',', 2), 'all') AS si, CAST(sum({IMP}) AS BIGINT) AS imp,
  CAST(sum(CASE WHEN {NONZERO} > 3 THEN {IMP} ELSE 0 END) AS BIGINT) AS dense_imp, count(*) AS n
FROM series GROUP BY 1 UNION ALL SELECT 'all', CAST(sum({IMP}) AS BIGINT), CAST(sum(CASE WHEN {NONZERO} > 3 THEN {IMP} ELSE 0 END) AS BIGINT),
  count(*)
FROM series""")
def agg_total_imp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select(part(F.col("uckey"), 1).alias("si"), Z.total(F.col("ts")).alias("imp"), (F.size(Z.nonzero(F.col("ts"))) > 3).alias("dense"))
    return s.rollup("si").agg(F.sum("imp").alias("imp"), F.sum(F.when(F.col("dense"), F.col("imp")).otherwise(0)).alias("dense_imp"), F.count("*").alias("n")).withColumn("si", F.coalesce("si", F.lit("all")))


@query(f"WITH {LOGS_SQL} SELECT count(*) AS n, count(DISTINCT aid) + 1 AS users, count(DISTINCT keyword) + 1 AS items FROM logs")
def agg_dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).agg(F.count("*").alias("n"), (F.countDistinct("aid") + 1).alias("users"), (F.countDistinct("keyword") + 1).alias("items"))


@query(f"""
WITH {PERSONA_SQL},
d AS (SELECT DISTINCT * FROM persona) SELECT aid, gender, CAST(age AS INT) AS age
FROM d WHERE aid IN (SELECT aid FROM d GROUP BY aid
HAVING count(*) = 1)""")
def agg_distinct_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_persona(persona(spark, sf_dir))


SCORES_SQL = f"{LOGS_SQL}, s AS (SELECT aid, keyword, sum(is_click) / CAST(count(*) AS DOUBLE) AS v FROM logs GROUP BY ALL)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aid, kws: map from keyword to share of clicks."""
    s = logs(spark, sf_dir).groupBy("aid", "keyword").agg((F.sum("is_click") / F.count("*")).alias("v"))
    return s.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("keyword", "v"))).alias("kws"))


@query(f"WITH {SCORES_SQL} SELECT round(avg(v) - 0.5 * stddev_pop(v), 6) AS threshold FROM s")
def agg_score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scores(spark, sf_dir).select(F.explode(F.map_values("kws")).alias("v"))
    return v.agg(F.round(F.avg("v") - 0.5 * F.stddev_pop("v"), 6).alias("threshold"))


@query(f"""
WITH {FACT_SQL},
d AS (SELECT uckey, split_part(uckey, ',', 2) AS si, year(day) AS y, sum(cnt) AS n
FROM fact GROUP BY ALL),
p AS (SELECT uckey, 100.0 * n / sum(n) OVER (PARTITION BY si, y) AS w
FROM d),
v AS (SELECT uckey, var_pop(w) AS v FROM p
GROUP BY 1) SELECT count(*) AS keys, count(*) FILTER (v <= 0.01) AS steady, round(count(*) FILTER (v <= 0.01) / CAST(count(*) AS DOUBLE), 6) AS share
FROM v""")
def agg_weight_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fact(spark, sf_dir).groupBy("uckey", F.year("day").alias("y")).agg(F.sum("cnt").alias("n")).withColumn("si", part(F.col("uckey"), 1))
    w = d.join(d.groupBy("si", "y").agg(F.sum("n").alias("total")), ["si", "y"]).select("uckey", (100.0 * F.col("n") / F.col("total")).alias("w"))
    v = w.groupBy("uckey").agg(F.var_pop("w").alias("v"))
    return v.agg(F.count("*").alias("keys"), F.count_if(F.col("v") <= 0.01).alias("steady"), F.round(F.count_if(F.col("v") <= 0.01) / F.count("*"), 6).alias("share"))


@query(f"""
WITH {LOGS_SQL},
u AS (SELECT aid, CAST(sum(is_click) AS DOUBLE) / nullif(count(*) FILTER (is_click = 0), 0) AS ctr
FROM logs WHERE keyword = 'kw2' AND sec BETWEEN 1704412800 AND 1705881600
GROUP BY 1) SELECT count(*) AS users, round(avg(coalesce(ctr, 0)), 6) AS ctr
FROM u""")
def agg_avg_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = logs(spark, sf_dir).where((F.col("keyword") == "kw2") & F.col("sec").between(1704412800, 1705881600))
    return L.rates(w, ["aid"]).agg(F.count("*").alias("users"), F.round(F.avg("ctr"), 6).alias("ctr"))


@query(f"""
WITH {LOGS_SQL}, {PERSONA_SQL} SELECT CAST(sum(is_click) AS BIGINT) AS clicks
FROM logs WHERE keyword = 'kw2' AND aid IN (SELECT aid
FROM persona WHERE gender = 'g_f')""")
def agg_keyword_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = persona(spark, sf_dir).where("gender = 'g_f'").select("aid").distinct()
    return logs(spark, sf_dir).where("keyword = 'kw2'").join(chosen, "aid", "left_semi").agg(F.sum("is_click").alias("clicks"))


@query(f"WITH {INVENTORY_SQL} SELECT day, {H_SUM} FROM inv WHERE g = 'O' AND a IN ('1', '2') GROUP BY 1")
def agg_inventory_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).where((F.col("g") == "O") & F.col("a").isin("1", "2")).groupBy("day").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)])


@query(f"WITH {INVENTORY_SQL} SELECT hour, " + ", ".join(f"round(CAST(sum(h{i}) * 0.75 AS DOUBLE), 4) AS h{i}" for i in range(4)) + " FROM inv WHERE g = 'O' GROUP BY 1")
def agg_inventory_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).where("g = 'O'").groupBy("hour").agg(*[F.round(F.sum(f"h{i}") * F.lit(0.75), 4).alias(f"h{i}") for i in range(4)])


@query(f"WITH {INVENTORY_SQL}, ratio(r, ratio) AS (VALUES ('0', 0.5), ('1', 0.5), ('2', 0.25)) SELECT day, " + ", ".join(f"round(CAST(sum(h{i} * ratio) AS DOUBLE), 4) AS h{i}" for i in range(4)) + " FROM inv JOIN ratio ON inv.r = ratio.r GROUP BY 1")
def agg_region_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = spark.createDataFrame([("0", 0.5), ("1", 0.5), ("2", 0.25)], "r string, ratio double")
    return inventory(spark, sf_dir).join(F.broadcast(ratio), "r").groupBy("day").agg(*[F.round(F.sum(F.col(f"h{i}") * F.col("ratio")), 4).alias(f"h{i}") for i in range(4)])


@query(f"WITH {TBR_SQL} SELECT a, g, CAST(sum(n) AS BIGINT) AS n FROM tbr WHERE list_has_any(string_split(au, '-'), ['au1', 'au7']) GROUP BY ALL")
def agg_tbr_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = behaviour(spark, sf_dir).groupBy("a", "g", "ai", "au").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("days"))
    total = F.aggregate(F.map_values("days"), F.lit(0).cast("long"), lambda s, x: s + x)
    return docs.where(F.arrays_overlap(F.split("au", "-"), F.array(F.lit("au1"), F.lit("au7")))).groupBy("a", "g").agg(F.sum(total).alias("n"))


@query(f"""
WITH {BOOKINGS_SQL} SELECT g AS day, arg_max(bk_id, amount * 100 + CAST(p AS INT)) AS bk_id, max(amount * 100 + CAST(p AS INT)) AS priority
FROM bookings GROUP BY 1""")
def agg_max_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bookings(spark, sf_dir).select(F.col("g")[0].alias("day"), "bk_id", (F.col("amount") * 100 + F.substring("bk_id", 2, 1).cast("int")).alias("priority"))
    return b.groupBy("day").agg(F.max_by("bk_id", "priority").alias("bk_id"), F.max("priority").alias("priority"))


@query(f"""
WITH {USERS_SQL} SELECT count(DISTINCT aid) AS users
FROM users WHERE day IN ('2024-01-03', '2024-01-04', '2024-01-09') AND list_has_any(kws, ['kw1', 'kw6'])""")
def agg_user_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir).where(F.col("day").isin("2024-01-03", "2024-01-04", "2024-01-09") & F.arrays_overlap("kws", F.array(F.lit("kw1"), F.lit("kw6"))))
    return u.agg(F.countDistinct("aid").alias("users"))


@query(f"""
WITH {LOGS_SQL},
s AS (SELECT day, keyword, CAST(sum(is_click) AS BIGINT) AS n
FROM logs GROUP BY ALL) SELECT day, string_agg(keyword || '=' || n, ','
ORDER BY keyword) AS allocated FROM s GROUP BY 1""")
def agg_merge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' keyword -> clicks maps of a day, summed key by key."""
    per = logs(spark, sf_dir).groupBy("day", "aid", "keyword").agg(F.sum("is_click").alias("n")).groupBy("day", "aid").agg(F.map_from_entries(F.collect_list(F.struct("keyword", "n"))).alias("m"))
    sums = per.select("day", F.explode("m").alias("k", "n")).groupBy("day", "k").agg(F.sum("n").alias("n"))
    return sums.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda s: F.concat_ws("=", s["k"], s["n"].cast("string"))), ",").alias("allocated"))


@query("""
SELECT o_orderstatus AS bucket, round(sum(o_totalprice) - sum(q), 2) AS remaining
FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q
FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
GROUP BY 1""")
def agg_remaining_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders leave of their price after the quantities allotted to line numbers."""
    alloc = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "q"))).alias("allocated"))
    o = table(spark, sf_dir, "orders").join(alloc, F.col("o_orderkey") == F.col("l_orderkey"))
    left = F.col("o_totalprice") - F.aggregate(F.map_values("allocated"), F.lit(0.0), lambda s, x: s + x)
    return o.groupBy(F.col("o_orderstatus").alias("bucket")).agg(F.round(F.sum(left), 2).alias("remaining"))


_KIND = f"CASE WHEN {NONZERO} > 4 THEN 'dense' WHEN {NONZERO} > 1 THEN 'sparse' ELSE 'other' END"


@query(f"""
WITH {SERIES_SQL} SELECT {_KIND} AS kind, count(*) AS keys, CAST(sum({IMP}) AS BIGINT) AS imp, round(100.0 * count(*) / (SELECT count(*) FROM series),
  6) AS key_percent, round(100.0 * sum({IMP}) / (SELECT sum({IMP}) FROM series), 6) AS imp_percent
FROM series GROUP BY 1""")
def agg_dense_sparse_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(Z.nonzero(F.col("ts")))
    g = series(spark, sf_dir).groupBy(F.when(n > 4, "dense").when(n > 1, "sparse").otherwise("other").alias("kind")).agg(F.count("*").alias("keys"), F.sum(Z.total(F.col("ts"))).alias("imp"))
    w = Window.partitionBy(F.lit(1))  # three rows
    return g.select("kind", "keys", "imp", F.round(100.0 * F.col("keys") / F.sum("keys").over(w), 6).alias("key_percent"), F.round(100.0 * F.col("imp") / F.sum("imp").over(w), 6).alias("imp_percent"))


@query(f"WITH {SCORES_SQL} SELECT aid, string_agg(keyword || '=' || printf('%.6f', v), ',' ORDER BY keyword) AS ctr FROM s GROUP BY 1")
def agg_keyword_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    return s.select("aid", F.array_join(F.transform(F.array_sort(F.map_entries("kws")), lambda e: F.concat_ws("=", e["key"], F.format_string("%.6f", e["value"]))), ",").alias("ctr"))


@query(f"""
WITH {LOGS_SQL},
i AS (SELECT DISTINCT keyword, kwi FROM logs) SELECT count(*) AS n, count(*) FILTER (c > 1) AS broken
FROM (SELECT keyword, count(DISTINCT kwi) AS c
FROM i GROUP BY 1)""")
def agg_index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = logs(spark, sf_dir).groupBy("keyword").agg(F.countDistinct("kwi").alias("c"))
    return per.agg(F.count("*").alias("n"), F.count_if(F.col("c") > 1).alias("broken"))


@query(f"""
WITH {FACT_SQL} SELECT count(*) AS n, count(DISTINCT uckey) AS keys, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day,
  count(*) FILTER (cnt IS NULL) AS nulls
FROM fact""")
def agg_table_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("uckey").alias("keys"), F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("cnt").isNull()).alias("nulls"))
