"""Section 2.11, logs: cleaning, timelines, samples, audience vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series as Z
from tidemark.functions.keys import joined_key, sha256_bucket
from tidemark.operators import logs as L
from tidemark.operators import similarity as V
from tidemark.operators.indexing import bucketed_row_index, dense_index
from tidemark.plans.aggregates import COUNTS_SQL, SCORES_SQL, daily_logs, scores
from tidemark.plans.inputs import LOGS_SQL, PERSONA_SQL, logs, persona, raw_events, table
from tidemark.plans.joins import KEYWORDS_SQL, VECTORS_SQL, keyword_table
from tidemark.plans.registry import query
from tidemark.plans.scans import BUCKET_SQL

_SINGLE = """
d AS (SELECT DISTINCT * FROM persona),
single AS (SELECT aid, gender, CAST(age AS INT) AS age
FROM d WHERE aid IN (SELECT aid FROM d GROUP BY aid HAVING count(*) = 1))"""


@query(f"""
WITH {LOGS_SQL}, {PERSONA_SQL}, {_SINGLE}, {KEYWORDS_SQL} SELECT event_id, raw.aid, day, gender,
  CASE gender WHEN 'g_f' THEN 1 WHEN 'g_m' THEN 0 ELSE 2 END AS gender_index, age, keyword, {BUCKET_SQL.format('raw.aid', 4)} AS aid_bucket
FROM raw JOIN single ON raw.aid = single.aid
JOIN kw ON raw.spread_app_id = kw.spread_app_id""")
def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = raw_events(spark, sf_dir).select("event_id", "aid", "spread_app_id", F.col("ts").alias("action_time"))
    clean = L.clean_log(log, L.clean_persona(persona(spark, sf_dir)), keyword_table(spark, sf_dir), 4)
    return clean.select("event_id", "aid", "day", "gender", "gender_index", "age", "keyword", "aid_bucket")


@query(f"WITH {LOGS_SQL} SELECT event_id, aid, sec, sec - sec % 14400 AS interval, is_click FROM logs")
def build_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_events(spark, sf_dir).select("event_id", "aid", "sec", "event_type")
    shows, clicks = (r.where(F.col("event_type") == t).drop("event_type") for t in ("view", "click"))
    return L.union_logs(shows, clicks, 14400)


@query(f"""
WITH {LOGS_SQL},
w AS (SELECT r_name AS region, r_regionkey + 1 AS w
FROM region),
c AS (SELECT region, sum(w) OVER (ORDER BY region) / CAST(sum(w) OVER () AS DOUBLE) AS high,
  (sum(w) OVER (ORDER BY region) - w) / CAST(sum(w) OVER () AS DOUBLE) AS low
FROM w),
p AS (SELECT event_id, cume_dist() OVER (PARTITION BY keyword ORDER BY event_id) AS x
FROM logs) SELECT event_id, region FROM p
JOIN c ON x > low AND x <= high""")
def assign_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), (F.col("r_regionkey") + 1).alias("weight"))
    return L.region_of(logs(spark, sf_dir), weights, "keyword", "event_id").select("event_id", "region")


@query(f"""
WITH {COUNTS_SQL},
k AS (SELECT * FROM c WHERE shows > 0),
i AS (SELECT aid, interval, string_agg(kwi || ':' || shows, ',' ORDER BY kwi) AS s, string_agg(kwi || ':' || clicks, ',' ORDER BY kwi) AS cl
FROM k GROUP BY ALL),
t AS (SELECT aid, string_agg(s, ' ' ORDER BY interval DESC) AS shows, string_agg(cl, ' ' ORDER BY interval DESC) AS clicks,
  {BUCKET_SQL.format('aid', 4)} AS b
FROM i GROUP BY aid) SELECT aid, shows, clicks, row_number() OVER (ORDER BY b, aid) AS aid_index
FROM t""")
def trainready_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.drop_unshown(L.click_show_counts(daily_logs(spark, sf_dir), ["aid", "interval", "kwi"]))
    t = L.timeline(c).select("aid", L.timeline_text("shows").alias("shows"), L.timeline_text("clicks").alias("clicks"))
    return bucketed_row_index(t, "aid", 4, into="aid_index")


_UK = f"""
{LOGS_SQL}, {PERSONA_SQL}, {_SINGLE},
u AS (SELECT keyword, gender, age, keyword || ',' || gender || ',' || age AS uckey, sec - sec % 86400 AS interval, kwi, is_click
FROM logs JOIN single ON logs.aid = single.aid)"""


@query(f"""
WITH {_UK},
c AS (SELECT uckey, interval, kwi, count(*) AS shows, sum(is_click) AS clicks
FROM u GROUP BY ALL),
i AS (SELECT uckey, interval, string_agg(kwi || ':' || shows, ',' ORDER BY kwi) AS s, string_agg(kwi || ':' || clicks, ',' ORDER BY kwi) AS cl
FROM c GROUP BY ALL),
t AS (SELECT uckey, string_agg(s, ' ' ORDER BY interval DESC) AS shows, string_agg(cl, ' ' ORDER BY interval DESC) AS clicks
FROM i GROUP BY 1) SELECT *, row_number() OVER (ORDER BY uckey) AS uckey_index, dense_rank() OVER (ORDER BY split_part(uckey, ',', 2)) AS gender_index
FROM t""")
def trainready_uckey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows count as shows here, clicked ones too."""
    log = daily_logs(spark, sf_dir).join(L.clean_persona(persona(spark, sf_dir)), "aid")
    log = log.withColumn("uckey", joined_key(F.col("keyword"), F.col("gender"), F.col("age")))
    t = L.timeline(L.click_show_counts(log, ["uckey", "interval", "kwi"], all_rows_are_shows=True), key="uckey")
    out = t.select("uckey", L.timeline_text("shows").alias("shows"), L.timeline_text("clicks").alias("clicks"), F.split("uckey", ",")[1].alias("gender"))
    return out.join(dense_index(out, "uckey", into="uckey_index"), "uckey").join(dense_index(out, "gender", into="gender_index"), "gender").drop("gender")


@query(f"""
WITH {COUNTS_SQL},
s AS (SELECT *, dense_rank() OVER (PARTITION BY aid ORDER BY interval DESC) - 1 AS n, row_number() OVER (PARTITION BY aid,
  interval ORDER BY kwi) - 1 AS m
FROM c),
h AS (SELECT x.aid, x.n, x.kwi, x.clicks, (SELECT string_agg(CAST(y.kwi AS VARCHAR), ',' ORDER BY y.n, y.kwi) FROM s y WHERE y.aid = x.aid AND y.n BETWEEN x.n + 1 AND x.n + 6) AS history, (SELECT count(*) FROM s y WHERE y.aid = x.aid AND y.n BETWEEN x.n + 1 AND x.n + 6) AS len
FROM s x WHERE interval >= 1705276800 AND (clicks > 0 OR (m % 5 = 0 AND n % 2 = 0))) SELECT aid, kwi AS keyword,
  CASE WHEN clicks > 0 THEN 1 ELSE 0 END AS label, history
FROM h WHERE len > 5""")
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.timeline(L.click_show_counts(daily_logs(spark, sf_dir), ["aid", "interval", "kwi"]))
    s = L.training_samples(t, 1705276800, 6)
    return s.select("aid", "keyword", "label", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query(f"""
WITH {SCORES_SQL},
k AS (SELECT DISTINCT keyword FROM s),
u AS (SELECT DISTINCT aid FROM s),
f AS (SELECT u.aid, k.keyword, coalesce(v, 0) AS v
FROM u CROSS JOIN k LEFT JOIN s ON s.aid = u.aid AND s.keyword = k.keyword) SELECT aid, string_agg(printf('%.4f', v), ','
ORDER BY keyword) AS vector, round(sum(v * v), 6) AS c1, {BUCKET_SQL.format('aid', 8)} AS alpha_bucket
FROM f GROUP BY aid""")
def build_score_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = logs(spark, sf_dir).agg(F.sort_array(F.collect_set("keyword")).alias("keys"))  # one row
    v = scores(spark, sf_dir).crossJoin(F.broadcast(keys)).select("aid", F.transform("keys", lambda k: F.coalesce(F.try_element_at("kws", k), F.lit(0.0))).alias("v"))
    return v.select("aid", F.array_join(F.transform("v", lambda x: F.format_string("%.4f", x)), ",").alias("vector"), F.round(Z.dot(F.col("v"), F.col("v")), 6).alias("c1"), sha256_bucket(F.col("aid"), 8).alias("alpha_bucket"))


@query(f"""
WITH v AS (SELECT vec_id, {BUCKET_SQL.format('CAST(vec_id AS VARCHAR)', 8)} AS bucket,
  list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS c1
FROM embeddings) SELECT bucket, string_agg(CAST(vec_id AS VARCHAR), ','
ORDER BY vec_id) AS ids, count(*) AS n, round(sum(c1), 4) AS c1_sum
FROM v GROUP BY 1""")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket's ids, vectors and squares, in the order of ids."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")).withColumn("bucket", sha256_bucket(F.col("vec_id").cast("string"), 8)).withColumn("c1", Z.dot(F.col("v"), F.col("v")))
    m = e.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v", "c1"))).alias("rows"))
    return m.select("bucket", F.array_join(F.transform("rows", lambda r: r["vec_id"].cast("string")), ",").alias("ids"), F.size("rows").cast("long").alias("n"), F.round(F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["c1"]), 4).alias("c1_sum"))


@query()
def kmeans_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.kmeans_clusters(table(spark, sf_dir, "embeddings"), 8)


@query()
def lsh_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.lsh_clusters(table(spark, sf_dir, "embeddings"))
    return c.join(c.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("id", "cluster", "size")


@query("""
WITH k AS (SELECT vec_id AS id, row_number() OVER (ORDER BY CAST(label AS VARCHAR), vec_id) - 1 AS pos
FROM embeddings),
n AS (SELECT greatest((count(*) + 6) // 60, 1) AS parts
FROM embeddings) SELECT id, CAST(least(pos // 60, parts - 1) AS INT) AS cluster
FROM k, n""")
def balance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.balanced_clusters(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), 60)


_EXT = f"""
{LOGS_SQL}, {VECTORS_SQL},
seeds AS (SELECT DISTINCT CAST(substr(aid, 2) AS BIGINT) AS id
FROM logs WHERE is_click = 1 AND keyword = 'kw1'),
ext AS (SELECT DISTINCT b AS id FROM top JOIN seeds ON a = seeds.id
WHERE b NOT IN (SELECT id FROM seeds))"""


def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = logs(spark, sf_dir).where("is_click = 1 and keyword = 'kw1'").select(F.expr("substring(aid, 2)").cast("long").alias("a")).distinct()
    near = V.top_similar(table(spark, sf_dir, "embeddings"), 5, within="label", queries=seeds)
    near = near.select(F.explode("near").alias("n")).select(F.col("n.b").alias("id")).distinct()
    return near.join(seeds.withColumnRenamed("a", "id"), "id", "left_anti")


@query(f"WITH {_EXT} SELECT id FROM ext")
def extend_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extended(spark, sf_dir)


@query(f"""
WITH {_EXT},
c AS (SELECT CAST(substr(aid, 2) AS BIGINT) AS id, sum(is_click) AS clicks, count(*) FILTER (is_click = 0) AS shows
FROM logs WHERE keyword = 'kw1' GROUP BY 1),
m AS (SELECT sum(clicks) / CAST(nullif(sum(shows), 0) AS DOUBLE) AS ctr
FROM c WHERE id IN (SELECT id FROM ext)),
r AS (SELECT sum(clicks) / CAST(nullif(sum(shows), 0) AS DOUBLE) AS ctr
FROM c) SELECT round(coalesce(m.ctr, 0), 6) AS model_ctr, round(r.ctr, 6) AS base_ctr, round(coalesce(m.ctr, 0) / nullif(r.ctr, 0), 6) AS lift
FROM m, r""")
def lift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword's click rate among the extended audience against everybody's."""
    log = logs(spark, sf_dir).where("keyword = 'kw1'").withColumn("id", F.expr("substring(aid, 2)").cast("long"))
    c = log.join(extended(spark, sf_dir).withColumn("in", F.lit(True)), "id", "left")
    rate = lambda keep: F.sum(F.when(keep, F.col("is_click")).otherwise(0)) / F.nullif(F.sum(F.when(keep & (F.col("is_click") == 0), 1).otherwise(0)), F.lit(0))
    r = c.agg(F.coalesce(rate(F.coalesce("in", F.lit(False))), F.lit(0.0)).alias("m"), rate(F.lit(True)).alias("r"))
    return r.select(F.round("m", 6).alias("model_ctr"), F.round("r", 6).alias("base_ctr"), F.round(F.col("m") / F.nullif(F.col("r"), F.lit(0.0)), 6).alias("lift"))
