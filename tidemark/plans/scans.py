"""Section 2.1: scans, sources, sinks, tables. Sinks write to the shared scratch space and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import sha256_bucket
from tidemark.operators import tables as T
from tidemark.plans.inputs import FACT_SQL, LOGS_SQL, fact, logs, raw_events, table
from tidemark.plans.registry import query
from tidemark.sources import tables as S
from tidemark.sources.scratch import new_folder

BUCKET_SQL = """
CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda i: ('0x'||substr(sha256({0}), CAST(i*8+1 AS INT), 8))::BIGINT)),
  lambda a,x: (a*4294967296 + x) % {1}) AS INT)"""


def _name(what: str) -> str:
    return f"{what}_{uuid.uuid4().hex[:12]}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scan(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(f"""
WITH b AS (SELECT c_name, c_mktsegment, {BUCKET_SQL.format('c_name', 10)} AS bucket_id
FROM customer) SELECT * FROM b WHERE bucket_id BETWEEN 2 AND 5 AND c_mktsegment <> 'MACHINERY'""")
def scan_bucket_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment").withColumn("bucket_id", sha256_bucket(F.col("c_name"), 10))
    return T.bucket_range(c, "bucket_id", 2, 5, F.col("c_mktsegment") != "MACHINERY")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 06:00:00'")
def scan_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.time_range(table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-12 06:00:00").select("event_id", "user_id", "event_type")


@query(f"""
WITH {LOGS_SQL},
b AS (SELECT *, {BUCKET_SQL.format('aid', 4)} AS aid_bucket
FROM raw) SELECT event_id, aid, day, aid_bucket
FROM b WHERE day BETWEEN '2024-01-03' AND '2024-01-20' AND ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts < TIMESTAMP '2024-01-19' AND aid_bucket = 1""")
def scan_day_bucket_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_events(spark, sf_dir).withColumn("aid_bucket", sha256_bucket(F.col("aid"), 4)).where(F.col("day").between("2024-01-03", "2024-01-20") & (F.col("aid_bucket") == 1))
    return T.time_range(r, "ts", "2024-01-03 12:00:00", "2024-01-19").select("event_id", "aid", "day", "aid_bucket")


@query(f"WITH {LOGS_SQL} SELECT DISTINCT sec - sec % 86400 AS interval_start FROM logs WHERE sec BETWEEN 1704412800 AND 1705881600")
def scan_distinct_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).where(F.col("sec").between(1704412800, 1705881600)).select((F.col("sec") - F.col("sec") % 86400).alias("interval_start")).distinct()


@query("SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY 1")
def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.write_table(table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers")), name := _name("segments"))
    return spark.table(name)


@query("""
SELECT o_orderkey, o_totalprice, o_orderstatus
FROM orders UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus
FROM orders WHERE o_orderstatus = 'F'""")
def write_table_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    S.write_partitioned(o, name := _name("orders"), ["o_orderstatus"])
    S.write_partitioned(o.where("o_orderstatus = 'F'").select("o_orderstatus", "o_totalprice", "o_orderkey"), name, ["o_orderstatus"], "append")
    return spark.table(name).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT s_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1")
def ctas_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    S.replace_table(s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers")), name := _name("suppliers"))
    S.replace_table(s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance")), name)
    return spark.table(name)


@query("SELECT p_brand, count(*) AS parts FROM part GROUP BY 1")
def create_then_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.create_table(spark, name := _name("brands"), "p_brand string, parts bigint")
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("parts"))
    for half in (F.length("p_brand") > 7, F.length("p_brand") <= 7):
        p.where(half).write.insertInto(name)
    return spark.table(name)


@query("""
SELECT o_orderstatus AS s, count(*) AS n, '2020-01-02' AS pt_d
FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), '2020-01-01'
FROM orders GROUP BY 1""")
def insert_overwrite_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, path = table(spark, sf_dir, "orders"), new_folder(spark, "by-day")
    count = lambda c: o.groupBy(F.col(c).alias("s")).agg(F.count("*").alias("n"))
    S.overwrite_partition(count("o_orderpriority"), path, "pt_d", "2020-01-01")
    S.overwrite_partition(count("o_orderpriority"), path, "pt_d", "2020-01-02")
    S.overwrite_partition(count("o_orderstatus"), path, "pt_d", "2020-01-02")
    return spark.read.schema("s string, n long, pt_d string").parquet(path)


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def swap_rename_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    S.write_table(r, name := _name("regions"))
    S.swap_table(r.select("r_regionkey", F.upper("r_name").alias("r_name")), name)
    return spark.table(name)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment FROM customer")
def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "persona-csv")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment")).write.option("header", True).csv(path)
    return S.import_csv(spark, path, "id string, segment string", "id")


@query(f"WITH {FACT_SQL}, g AS (SELECT uckey, hour, CAST(sum(cnt) AS BIGINT) AS n FROM fact GROUP BY ALL), w AS (SELECT uckey, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN hour = {h} THEN n END), 0) AS BIGINT) AS h{h}" for h in range(1, 8)) + " FROM g GROUP BY uckey) SELECT uckey, " + " || ',' || ".join(f"h{h}" for h in range(1, 8)) + " AS ts FROM w")
def csv_wide_to_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fact(spark, sf_dir).groupBy("uckey").agg(*[F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("cnt"))), F.lit(0)).cast("long").alias(f"h{h}") for h in range(1, 8)])
    path = new_folder(spark, "wide-csv")
    wide.write.csv(path)
    read = spark.read.schema("uckey string, " + ", ".join(f"h{h} long" for h in range(1, 8))).csv(path)
    return read.select("uckey", F.array(*[f"h{h}" for h in range(1, 8)]).alias("a")).select("uckey", F.array_join(F.col("a").cast("array<string>"), ",").alias("ts"))


@query(f"WITH {LOGS_SQL} SELECT DISTINCT spread_app_id, 'kw-' || substr(spread_app_id, 4) AS keyword FROM raw")
def read_keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "keyword-lines")
    raw_events(spark, sf_dir).select("spread_app_id").distinct().select(F.concat(F.lit("  "), "spread_app_id", F.lit(" \t  "), F.lit("kw-"), F.expr("substring(spread_app_id, 4)"), F.lit(" "))).write.text(path)
    return S.keyword_lines(spark, path)


@query(f"""
WITH {LOGS_SQL},
i AS (SELECT keyword, row_number() OVER (ORDER BY keyword) - 1 AS ix
FROM (SELECT DISTINCT keyword FROM logs)), d(keyword, category) AS (VALUES ('kw0', 'video'), ('kw1', 'video'), ('kw2', 'shopping'), ('kw3', 'travel'),
  ('kw99', 'none')) SELECT d.keyword, category, ix
FROM d JOIN i ON d.keyword = i.keyword""")
def dict_to_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.indexing import dense_index

    known = spark.createDataFrame([("kw0", "video"), ("kw1", "video"), ("kw2", "shopping"), ("kw3", "travel"), ("kw99", "none")], "keyword string, category string")
    return F.broadcast(known).join(dense_index(logs(spark, sf_dir), "keyword", first=0, into="ix"), "keyword").select("keyword", "category", "ix")


@query(f"WITH {LOGS_SQL} SELECT aid, keyword, is_click, (SELECT count(*) FROM logs) AS n_rows FROM logs")
def export_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "training-set")
    S.export_training_set(logs(spark, sf_dir).select("aid", "keyword", "is_click"), path)
    return spark.read.parquet(f"{path}/rows").crossJoin(F.broadcast(spark.read.schema("rows long").json(f"{path}/count"))).withColumnRenamed("rows", "n_rows")


@query("SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1")
def write_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "json")
    table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("k string, n long").json(path)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS body FROM part""")
def doc_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"])


@query("SELECT p_partkey, p_brand, p_size FROM part")
def doc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parsed(S.documents(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"]), "p_partkey long, p_brand string, p_size int")


@query("SELECT round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, 'v1' AS model FROM lineitem")
def one_row_stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").agg(F.struct(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std")).alias("stats"), F.struct(F.lit("v1").alias("name")).alias("model_info"))
    path = new_folder(spark, "stats")
    stats.write.json(path)
    read = spark.read.schema("model_info struct<name: string>, stats struct<mean: double, std: double>").json(path)
    return S.only_row(read).select("stats.mean", "stats.std", F.col("model_info.name").alias("model"))


@query("SELECT true AS before, false AS other, count(*) AS n FROM nation")
def table_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.write_table(table(spark, sf_dir, "nation"), name := _name("nations"))
    found = [spark.catalog.tableExists(n) for n in (name, f"{name}_no")]
    return spark.table(name).agg(F.lit(found[0]).alias("before"), F.lit(found[1]).alias("other"), F.count("*").alias("n"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def sql_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))
