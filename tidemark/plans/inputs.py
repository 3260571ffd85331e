"""The given tables as traffic facts, logs, vectors, inventory, channels and bookings, in Spark and in DuckDB's SQL.

Each *_SQL text is a list of common table expressions, to stand after WITH.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Traffic facts: key m,si,t,g,a,pm,r; day; price category; count ------------------------------------------------------
FACT_SQL = """
fact AS (
  SELECT l_returnflag || ',slot' || (l_partkey % 5) || ',' || l_linestatus || ',' || o_orderstatus || ',' || l_linenumber || ',CPM,' || (l_suppkey % 5) AS uckey,
         CAST(l_shipdate AS DATE) AS day, CAST(l_linenumber AS INT) AS hour,
         CASE WHEN l_extendedprice < 30000 THEN '1' WHEN l_extendedprice < 50000 THEN '2' ELSE '3' END AS price_cat, CAST(l_quantity AS BIGINT) AS cnt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _of_orders(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines joined with o_orderstatus. Lines come with what is derived from them alone, as the join shuffles it."""
    od = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return lines.join(od, "l_orderkey")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("l_extendedprice") < 30000, "1").when(F.col("l_extendedprice") < 50000, "2").otherwise("3")
    part = lambda c: (F.col(c) % 5).cast("string")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", part("l_partkey").alias("si"), "l_linestatus", "l_linenumber", part("l_suppkey").alias("r"), F.to_date("l_shipdate").alias("day"), price.alias("price_cat"),
        F.col("l_quantity").cast("long").alias("cnt"),
    )
    key = F.concat_ws(",", "l_returnflag", F.concat(F.lit("slot"), "si"), "l_linestatus", "o_orderstatus", F.col("l_linenumber").cast("string"), F.lit("CPM"), "r")
    return _of_orders(lines, spark, sf_dir).select(key.alias("uckey"), "day", F.col("l_linenumber").alias("hour"), "price_cat", "cnt")


# Yearly series: one point for each of the seven years, null where nothing came ----------------------------------------
YEARS = list(range(1995, 2002))
SERIES_SQL = FACT_SQL + """,
yearly AS (SELECT uckey, price_cat, year(day) AS y, CAST(sum(cnt) AS BIGINT) AS n FROM fact GROUP BY ALL),
keyed AS (SELECT DISTINCT uckey, price_cat FROM fact),
series AS (
  SELECT k.uckey, k.price_cat, list(n ORDER BY g.y) AS ts
  FROM keyed k CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y) g LEFT JOIN yearly t ON t.uckey = k.uckey AND t.price_cat = k.price_cat AND t.y = g.y
  GROUP BY k.uckey, k.price_cat)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uckey, price_cat, ts: array of longs over YEARS. Written once, as plans read it several times."""
    return written(series_of(fact(spark, sf_dir)), "series")


def series_of(facts: DataFrame) -> DataFrame:
    by_year = facts.groupBy("uckey", "price_cat").agg(*[F.sum(F.when(F.year("day") == y, F.col("cnt"))).alias(f"y{y}") for y in YEARS])
    return by_year.select("uckey", "price_cat", F.array(*[f"y{y}" for y in YEARS]).alias("ts"))


def text_of(array: str) -> F.Column:
    """An array at the edge: values joined by commas, '-' for null."""
    return F.array_join(F.col(array).cast("array<string>"), ",", "-")


# Logs: shows and clicks of keywords ------------------------------------------------------------------------------------
LOGS_SQL = """
raw AS (
  SELECT event_id, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS aid, ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, strftime(ts, '%Y-%m-%d') AS day, event_type,
         'app' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 12) AS spread_app_id, value
  FROM events),
logs AS (
  SELECT event_id, aid, ts, sec, day, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click, replace(spread_app_id, 'app', 'kw') AS keyword, CAST(replace(spread_app_id, 'app', '') AS BIGINT) AS kwi
  FROM raw WHERE event_type IN ('view', 'click'))"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long") % 12
    return e.select("event_id", F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("aid"), "ts", F.unix_timestamp("ts").alias("sec"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.concat(F.lit("app"), k).alias("spread_app_id"), "value")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return r.select("event_id", "aid", "ts", "sec", "day", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("is_click"), F.regexp_replace("spread_app_id", "app", "kw").alias("keyword"), F.regexp_replace("spread_app_id", "app", "").cast("long").alias("kwi"))


# Personas --------------------------------------------------------------------------------------------------------------
PERSONA_SQL = """
persona AS (
  SELECT 'u' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, '0') AS aid, CASE c_nationkey % 3 WHEN 0 THEN 'g_f' WHEN 1 THEN 'g_m' ELSE 'g_x' END AS gender, CAST(c_nationkey % 7 AS VARCHAR) AS age
  FROM customer)"""


def persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    g = F.col("c_nationkey") % 3
    return c.select(F.concat(F.lit("u"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 6, "0")).alias("aid"), F.when(g == 0, "g_f").when(g == 1, "g_m").otherwise("g_x").alias("gender"), (F.col("c_nationkey") % 7).cast("string").alias("age"))


# Inventory: key attributes, day, impressions by price category --------------------------------------------------------
INVENTORY_SQL = """
inv AS (
  SELECT l_returnflag AS m, 'slot' || (l_partkey % 5) AS si, l_linestatus AS t, o_orderstatus AS g, CAST(l_linenumber AS VARCHAR) AS a, CAST(l_suppkey % 5 AS VARCHAR) AS r, strftime(l_shipdate, '%Y') AS day,
         CAST(l_linenumber * 3 AS INT) AS hour,
         CAST(sum(CASE WHEN l_extendedprice < 15000 THEN l_quantity ELSE 0 END) AS BIGINT) AS h0, CAST(sum(CASE WHEN l_extendedprice >= 15000 AND l_extendedprice < 30000 THEN l_quantity ELSE 0 END) AS BIGINT) AS h1,
         CAST(sum(CASE WHEN l_extendedprice >= 30000 AND l_extendedprice < 50000 THEN l_quantity ELSE 0 END) AS BIGINT) AS h2, CAST(sum(CASE WHEN l_extendedprice >= 50000 THEN l_quantity ELSE 0 END) AS BIGINT) AS h3
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: plans read it several times, and it has far fewer rows than what it sums."""
    j = unpacked_lines(_of_orders(packed_lines(table(spark, sf_dir, "lineitem")), spark, sf_dir)).withColumnRenamed("o_orderstatus", "g")
    sums = [F.sum(F.when(F.col("band") == i, F.col("q")).otherwise(0.0)).cast("long").alias(f"h{i}") for i in range(4)]
    return written(j.groupBy("m", "si", "t", "g", "a", "r", "day", "hour").agg(*sums), "inventory")


def packed_lines(lines: DataFrame) -> DataFrame:
    """l_orderkey, packed, q, m, t: what inventory needs of a line, in as few columns as the join can shuffle.

    packed: 32 bits of the line number, and above them year + 300,000 (0 for null) and four digits: the rests of part and
    supplier by 5, plus 5, the price band plus 1, each 0 for null, and whether the line number is null.
    """
    p = F.col("l_extendedprice")
    band = F.when(p < 15000, 1).when(p < 30000, 2).when(p < 50000, 3).when(p >= 50000, 4).otherwise(0)
    digit = lambda c: F.coalesce(F.col(c) % 5 + 5, F.lit(0)).cast("long")
    digits = ((digit("l_partkey") * 10 + digit("l_suppkey")) * 10 + band) * 2 + F.col("l_linenumber").isNull().cast("int")
    high = digits * 1_000_000 + F.coalesce(F.year("l_shipdate") + 300_000, F.lit(0))
    number = F.coalesce(F.col("l_linenumber"), F.lit(0)).cast("long")
    return lines.select("l_orderkey", F.shiftleft(high, 32).bitwiseOR(number.bitwiseAND(0xFFFFFFFF)).alias("packed"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("t"))


def unpacked_lines(lines: DataFrame) -> DataFrame:
    """The columns of inventory's lines, with o_orderstatus if it is there."""
    high, low = F.shiftrightunsigned("packed", 32), F.col("packed").bitwiseAND(0xFFFFFFFF)
    digits, year = F.expr("high div 1000000"), F.col("high") % 1_000_000
    rest = lambda at: F.expr(f"if(digits div {at} % 10 > 0, cast(digits div {at} % 10 - 5 as string), null)")
    known = lines.withColumn("high", high).withColumn("digits", digits).withColumn("number", F.when(F.col("digits") % 2 == 0, F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")))
    day = F.when(year > 0, F.date_format(F.make_date((year - 300_000).cast("int"), F.lit(1), F.lit(1)), "yyyy"))
    out = known.select(
        *[c for c in ("l_orderkey", "o_orderstatus") if c in lines.columns], "m", F.concat(F.lit("slot"), rest(200)).alias("si"), "t", F.col("number").cast("string").alias("a"), rest(20).alias("r"),
        day.alias("day"), (F.col("number") * 3).alias("hour"), F.expr("nullif(cast(digits div 2 % 10 as int), 0) - 1").alias("band"), "q",
    )
    return out.drop("l_orderkey") if "o_orderstatus" in lines.columns else out


# Targeting channels: attribute lists, empty for no restriction ---------------------------------------------------------
CHANNELS_SQL = """
tc AS (
  SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['O'] ELSE ['O', 'F'] END AS g,
         CASE WHEN n_nationkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [CAST(n_nationkey % 7 + 1 AS VARCHAR), CAST((n_nationkey + 3) % 7 + 1 AS VARCHAR)] END AS a,
         CASE WHEN n_nationkey % 2 = 0 THEN ['slot' || (n_nationkey % 5)] ELSE CAST([] AS VARCHAR[]) END AS si,
         CASE WHEN n_nationkey % 5 = 0 THEN ['N', 'R'] ELSE CAST([] AS VARCHAR[]) END AS m,
         CASE WHEN n_nationkey % 6 = 0 THEN ['F'] ELSE CAST([] AS VARCHAR[]) END AS t,
         CASE WHEN n_nationkey % 7 < 2 THEN [CAST(n_regionkey AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS r
  FROM nation)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    return n.select(
        k.alias("id"), F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("F"))).alias("g"),
        F.when(k % 4 == 0, none).otherwise(F.array((k % 7 + 1).cast("string"), ((k + 3) % 7 + 1).cast("string"))).alias("a"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("slot"), k % 5))).otherwise(none).alias("si"), F.when(k % 5 == 0, F.array(F.lit("N"), F.lit("R"))).otherwise(none).alias("m"),
        F.when(k % 6 == 0, F.array(F.lit("F"))).otherwise(none).alias("t"), F.when(k % 7 < 2, F.array(F.col("n_regionkey").cast("string"))).otherwise(none).alias("r"),
    )


MATCH_SQL = " AND ".join(f"(len(tc.{c}) = 0 OR list_contains(tc.{c}, inv.{c}))" for c in ("m", "si", "t", "g", "a", "r"))

# Behaviour documents: per key and day counts of users with multi-valued attributes -----------------------------------
TBR_SQL = """
tbr AS (
  SELECT a, g, 'ai' || (k % 3) || '-ai' || (k % 4 + 3) AS ai, 'au' || (k % 5) || '-au' || (k % 6 + 5) AS au, day, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT CAST(user_id % 7 + 1 AS VARCHAR) AS a, CASE user_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS g, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day FROM events)
  GROUP BY ALL)"""


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long")
    e = table(spark, sf_dir, "events").select((u % 7 + 1).cast("string").alias("a"), F.when(u % 3 == 0, "O").when(u % 3 == 1, "F").otherwise("P").alias("g"), k.alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    k = F.col("k")
    return e.groupBy("a", "g", F.concat(F.lit("ai"), k % 3, F.lit("-ai"), k % 4 + 3).alias("ai"), F.concat(F.lit("au"), k % 5, F.lit("-au"), k % 6 + 5).alias("au"), "day").agg(F.count("*").alias("n"))


# Bookings: one for each order status and priority ---------------------------------------------------------------------
BOOKINGS_SQL = """
bookings AS (
  SELECT 'b' || substr(o_orderpriority, 1, 1) || o_orderstatus AS bk_id, CAST(count(*) * 40 AS BIGINT) AS amount, o_orderstatus AS g, substr(o_orderpriority, 1, 1) AS p,
         list_sort(list_distinct(list(strftime(o_orderdate, '%Y')))) AS days
  FROM orders GROUP BY ALL),
query AS (SELECT bk_id, amount, days, [g] AS g, [p, CAST(CAST(p AS INT) + 2 AS VARCHAR)] AS a FROM bookings)"""


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bk_id, amount, days, and the targeting lists g and a."""
    o = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("p"), F.col("o_orderstatus").alias("s"), F.date_format("o_orderdate", "yyyy").alias("day"))
    b = o.groupBy("p", "s").agg((F.count("*") * 40).alias("amount"), F.sort_array(F.collect_set("day")).alias("days"))
    return b.select(F.concat(F.lit("b"), "p", "s").alias("bk_id"), "amount", "days", F.array("s").alias("g"), F.array("p", (F.col("p").cast("int") + 2).cast("string")).alias("a"))
