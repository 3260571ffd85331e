"""Sections 2.12 and 2.14: user-defined functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.folds import Coverage, folded
from tidemark.operators.scoring import scored, value_bands
from tidemark.operators.sketches import distinct_estimate, sliding_sketch
from tidemark.operators.table_functions import register_table_functions
from tidemark.plans.inputs import LOGS_SQL, SERIES_SQL, logs, series, table
from tidemark.plans.registry import query
from tidemark.streaming import windows as W

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@query("SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents, CAST(trunc(value) AS BIGINT) AS whole, value > 100 AS high FROM events")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed scalar function in batches, with a struct of several types as its result."""
    bands = F.pandas_udf(value_bands, "struct<cents: long, whole: long, high: boolean>")
    return table(spark, sf_dir, "events").select("event_id", bands("value").alias("b")).select("event_id", "b.cents", "b.whole", "b.high")


@query("SELECT p_partkey, round(p_size * p_retailprice / 100, 4) AS score FROM part")
def udf_struct_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over whole rows."""
    return scored(table(spark, sf_dir, "part"), ["p_partkey"], lambda rows: (rows["p_size"] * rows["p_retailprice"] / 100).round(4))


def scaled(low: float, high: float):
    """A Column function that closes over its parameters."""
    return lambda c: (F.least(F.greatest(c, F.lit(low)), F.lit(high)) - low) / (high - low)


@query("SELECT p_partkey, round((least(greatest(p_size, 10), 40) - 10) / 30.0, 6) AS s FROM part")
def udf_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scaled(10.0, 40.0)(F.col("p_size")), 6).alias("s"))


@query(f"""
WITH {LOGS_SQL},
g AS (SELECT keyword, sec, sec - max(sec) OVER (PARTITION BY keyword ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM logs)
SELECT keyword, count(*) AS n, CAST(sum(least(coalesce(gap, 900), 900)) AS BIGINT) AS covered FROM g GROUP BY 1""")
def udaf_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate: how many seconds a keyword's visits cover if each lasts a quarter of an hour."""
    return folded(logs(spark, sf_dir), ["keyword"], Coverage("sec", 900))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, 'kept' AS part, l_quantity - 10 AS q
FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'moved', least(l_quantity, 10)
FROM lineitem""")
def udtf_flatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row becomes one or two, by a table function in a lateral join."""
    register_table_functions(spark)
    sql = "SELECT l_orderkey, l_linenumber, l_partkey, part, q FROM {rows}, LATERAL split_double(l_quantity, 10)"
    return spark.sql(sql, rows=table(spark, sf_dir, "lineitem"))


@query("""
WITH r AS (SELECT l_orderkey, l_extendedprice, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS upto FROM lineitem),
m AS (SELECT *, greatest(least(q, 40 - upto + q), 0) AS moved FROM r)
SELECT l_orderkey, l_extendedprice, 'moved' AS part, CAST(moved AS DOUBLE) AS q FROM m WHERE moved > 0
UNION ALL SELECT l_orderkey, l_extendedprice, 'kept', CAST(q - moved AS DOUBLE) FROM m WHERE q > moved""")
def udtf_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 of each order's quantities are moved, the cheapest lines first, by a table function over its lines."""
    register_table_functions(spark)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    return spark.sql("SELECT * FROM split_running(TABLE({lines}), 40, 'l_orderkey', 'l_extendedprice', 'l_quantity')", lines=lines)


@query(f"""
WITH {SERIES_SQL},
x AS (SELECT uckey, price_cat, unnest(range(7)) AS pos, unnest(ts) AS n
FROM series) SELECT uckey, price_cat, CAST(pos AS INT) AS pos, CASE WHEN n > 20 THEN 1 ELSE 0 END AS label
FROM x WHERE n IS NOT NULL""")
def udtf_explode_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.filter(F.transform("ts", lambda x, i: F.struct(i.alias("pos"), x.alias("n"), F.when(x > 20, 1).otherwise(0).alias("label"))), lambda s: s["n"].isNotNull())
    return series(spark, sf_dir).select("uckey", "price_cat", F.inline(samples)).drop("n")


@query("""
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n
FROM events GROUP BY ALL HAVING CAST(strftime(max(ts), '%Y-%m-%d') AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts)
FROM events) - INTERVAL 1 DAY""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed; the batch form gives the same rows."""
    s = W.event_stream(spark, f"{sf_dir}/events.parquet", _EVENTS)
    return W.drained(W.daily_counts(s, "ts", ["event_type"]), "stream-days").select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query(f"""
WITH {LOGS_SQL},
w AS (SELECT aid, keyword, sec - sec % 43200 AS start, CAST(sum(is_click) AS BIGINT) AS clicks, CAST(sum(1 - is_click) AS BIGINT) AS shows
FROM logs GROUP BY ALL) SELECT * FROM w WHERE start + 43200 <= (SELECT epoch(max(ts))
FROM logs) - 21600""")
def stream_click_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.event_stream(spark, f"{sf_dir}/events.parquet", _EVENTS).where(F.col("event_type").isin("view", "click"))
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long") % 12
    s = s.select("ts", F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("aid"), F.concat(F.lit("kw"), k).alias("keyword"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("is_click"))
    return W.drained(W.click_show(s, "ts", ["aid", "keyword"], "12 hours", "6 hours"), "stream-clicks").select("aid", "keyword", F.unix_timestamp("window_start").alias("start"), "clicks", "shows")


_REGISTERS = """
h AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, md5(user_id::VARCHAR) AS h FROM events WHERE user_id IS NOT NULL),
s AS (SELECT event_type, day, ('0x' || h[1:3])::INT AS register, max(53 - CASE WHEN ('0x' || h[4:16])::BIGINT > 0 THEN length(bin(('0x' || h[4:16])::BIGINT)) ELSE 0 END) AS rank FROM h GROUP BY ALL)"""
_ESTIMATE = "CASE WHEN raw <= 10240 AND n < 4096 THEN 4096 * ln(4096 / (4096.0 - n)) ELSE raw END"


@query(f"""
WITH {_REGISTERS},
closed AS (SELECT * FROM s WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
m AS (SELECT event_type, first, register, max(rank) AS rank FROM (SELECT *, unnest([day - 2, day - 1, day]) AS first FROM closed) WHERE first + 2 <= (SELECT max(day) FROM closed) GROUP BY ALL),
e AS (SELECT event_type, first, count(*) AS n, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (sum(pow(2.0, -rank)) + 4096 - count(*)) AS raw FROM m GROUP BY ALL)
SELECT event_type, strftime(first, '%Y-%m-%d') AS first_day, CAST(round({_ESTIMATE}) AS BIGINT) AS users FROM e""")
def stream_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of every three days by event type, about: the stream keeps a sketch of each day, which are then merged."""
    stream = W.event_stream(spark, f"{sf_dir}/events.parquet", _EVENTS)
    daily = W.drained(W.daily_sketches(stream, "ts", "user_id", ["event_type"]), "stream-users").withColumn("day", F.to_date("window_start"))
    users = distinct_estimate(sliding_sketch(daily, ["event_type"], 3), ["event_type", "first_day"], "users")
    return users.select("event_type", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), "users")


@query("""
WITH d AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day FROM events),
w AS (SELECT event_type, user_id, unnest([day - 2, day - 1, day]) AS first FROM d)
SELECT event_type, strftime(first, '%Y-%m-%d') AS first_day, count(DISTINCT user_id) AS users
FROM w WHERE CAST(first AS TIMESTAMP) + INTERVAL 3 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
GROUP BY ALL""")
def stream_exact_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of three days by event type, each counted once."""
    s = W.event_stream(spark, f"{sf_dir}/events.parquet", _EVENTS)
    days = W.drained(W.exact_user_days(s, "ts", "user_id", ["event_type"], 3), "stream-exact-users")
    return days.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("first_day"), "users")
