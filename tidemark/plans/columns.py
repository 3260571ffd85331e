"""Sections 2.8 to 2.10: scalar functions over strings, dates, arrays, maps, documents, numbers and series."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import amounts as M
from tidemark.functions import calendar as C
from tidemark.functions import keys as K
from tidemark.functions import series as Z
from tidemark.operators import logs as L
from tidemark.operators import series as S
from tidemark.plans.aggregates import COUNTS_SQL, SCORES_SQL, daily_logs, scores
from tidemark.plans.filters import IMP
from tidemark.plans.inputs import CHANNELS_SQL, FACT_SQL, INVENTORY_SQL, LOGS_SQL, SERIES_SQL, TBR_SQL, YEARS, behaviour, channels, fact, inventory, logs, series, table, text_of
from tidemark.plans.registry import query
from tidemark.plans.scans import BUCKET_SQL

_KEY = "uckey, price_cat"
_JOIN = "array_to_string(list_transform({0}, lambda x: CAST({1} AS VARCHAR)), ',')"


# 2.8 Strings, hashes, dates --------------------------------------------------------------------------------------------
@query(f"SELECT c_name, {BUCKET_SQL.format('c_name', 10)} AS b10, {BUCKET_SQL.format('c_name', 997)} AS b997 FROM customer")
def sha256_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_name", K.sha256_bucket(F.col("c_name"), 10).alias("b10"), K.sha256_bucket(F.col("c_name"), 997).alias("b997"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def day_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.day_of(F.col("ts")).alias("day"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events")
def epoch_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.epoch_seconds(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).alias("sec"))


@query(f"WITH {LOGS_SQL} SELECT event_id, sec - sec % 1800 AS start FROM logs")
def interval_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("event_id", C.interval_start(F.col("sec"), 1800).alias("start"))


@query(f"WITH {LOGS_SQL}, r AS (SELECT min(sec) AS a, max(sec) AS b FROM logs) SELECT unnest(range(a - a % 86400, b + 1, 86400)) AS start FROM r")
def interval_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = logs(spark, sf_dir).agg(F.min("sec").alias("a"), F.max("sec").alias("b"))
    return r.select(F.explode(C.interval_starts(F.col("a"), F.col("b"), 86400)).alias("start"))


@query("""
WITH r AS (SELECT CAST(max(o_orderdate) AS DATE) AS d
FROM orders) SELECT strftime(CAST(unnest(range(CAST(d - 29 AS TIMESTAMP), CAST(d + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE), '%Y%m%d') AS day
FROM r""")
def day_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate")).alias("d"))
    return last.select(F.explode(C.days_back(F.col("d"), 30)).alias("day")).select(F.date_format("day", "yyyyMMdd").alias("day"))


@query("""
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y%m%d') AS later, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next
FROM orders""")
def advance_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.date_add(d, 10), "yyyyMMdd").alias("later"), F.date_format(F.date_add(d, 1), "yyyy-MM-dd").alias("next"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dashed, strftime(o_orderdate, '%Y%m%d') AS plain, CAST(NULL AS VARCHAR) AS odd
FROM orders""")
def date_dash_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("b"))
    return o.select("o_orderkey", C.with_dashes(F.col("a")).alias("dashed"), C.without_dashes(F.col("b")).alias("plain"), C.with_dashes(F.substring("a", 1, 7)).alias("odd"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dayofweek(l_shipdate) = dayofweek(o_orderdate) AS same
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def same_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.dayofweek("l_shipdate") == F.dayofweek("o_orderdate")).alias("same"))


@query("""
SELECT o_orderkey, round(sin((isodow(o_orderdate) - 1) * 2 * pi() / 7), 6) AS s, round(cos((isodow(o_orderdate) - 1) * 2 * pi() / 7), 6) AS c
FROM orders""")
def dow_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.weekday_angle(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sin(a), 6).alias("s"), F.round(F.cos(a), 6).alias("c"))


_RANGES = """
r AS (SELECT n_nationkey AS id, DATE '2024-01-01' + CAST(n_nationkey AS INT) AS st,
  DATE '2024-01-01' + CAST(n_nationkey + n_nationkey % 3 AS INT) AS ed, n_nationkey % 24 AS sh, (n_nationkey * 5) % 24 AS eh
FROM nation),
p AS (SELECT id, unnest(range(st + INTERVAL (sh) HOUR, ed + INTERVAL (eh) HOUR + INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS t
FROM r)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    day = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d.cast("int"))
    r = table(spark, sf_dir, "nation").select(k.alias("id"), day(k).alias("st"), day(k + k % 3).alias("ed"), (k % 24).cast("int").alias("sh"), (k * 5 % 24).cast("int").alias("eh"))
    return r.select("id", F.explode(C.hour_points(F.col("st"), F.col("ed"), F.col("sh"), F.col("eh"))).alias("t"))


@query(f"""
WITH {_RANGES} SELECT id, strftime(t, '%Y-%m-%d') AS day, string_agg(CAST(hour(t) AS VARCHAR), ','
ORDER BY t) AS hours, count(*) AS n FROM p
GROUP BY id, strftime(t, '%Y-%m-%d')""")
def range_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ranges(spark, sf_dir).groupBy("id", C.day_of(F.col("t")).alias("day")).agg(F.array_sort(F.collect_list(F.hour("t"))).alias("h"))
    return g.select("id", "day", F.array_join(F.col("h").cast("array<string>"), ",").alias("hours"), F.size("h").cast("long").alias("n"))


@query(f"WITH {_RANGES} SELECT strftime(t, '%Y-%m-%d') AS day, CAST(min(hour(t)) AS INT) AS sh, CAST(max(hour(t)) AS INT) AS eh FROM p GROUP BY 1")
def range_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges(spark, sf_dir).groupBy(C.day_of(F.col("t")).alias("day")).agg(F.min(F.hour("t")).alias("sh"), F.max(F.hour("t")).alias("eh"))


@query("""
WITH r AS (SELECT CAST(max(ts) AS DATE) AS d
FROM events),
s AS (SELECT CAST(unnest(range(CAST(d - 32 AS TIMESTAMP), CAST(d - 2 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS first_day
FROM r) SELECT strftime(first_day, '%Y-%m-%d') AS first_day, strftime(first_day + 2, '%Y-%m-%d') AS last_day
FROM s""")
def prediction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = table(spark, sf_dir, "events").agg(F.to_date(F.max("ts")).alias("d"))
    w = today.select(F.explode(C.windows_before(F.col("d"), 3)).alias("f"))
    return w.select(F.date_format("f", "yyyy-MM-dd").alias("first_day"), F.date_format(F.date_add("f", 2), "yyyy-MM-dd").alias("last_day"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 ELSE 2 END AS ix,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'g_f' WHEN 'MACHINERY' THEN 'g_m' ELSE 'g_m_g_f' END AS name
FROM customer""")
def gender_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.when(F.col("c_mktsegment") == "BUILDING", "g_f").when(F.col("c_mktsegment") == "MACHINERY", "g_m").otherwise("x")
    ix = K.matched_index(g, L.GENDER_INDEX, 2)
    return table(spark, sf_dir, "customer").select("c_custkey", ix.alias("ix"), F.element_at(F.array(F.lit("g_m"), F.lit("g_f"), F.lit("g_m_g_f")), ix + 1).alias("name"))


@query(f"WITH {FACT_SQL} SELECT DISTINCT uckey || '-' || price_cat AS page_ix, uckey || ',' || price_cat AS uph FROM fact")
def page_ix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).select(F.concat_ws("-", "uckey", "price_cat").alias("page_ix"), F.concat_ws(",", "uckey", "price_cat").alias("uph")).distinct()


@query(f"""
WITH {CHANNELS_SQL} SELECT id, lower(array_to_string(g, '-')) || '|' || lower(array_to_string(a, '-')) || '|' || lower(array_to_string(si,
  '-')) || '|' || CASE WHEN id % 3 < 2 THEN 'CPM' ELSE 'CPD' END AS k
FROM tc""")
def query_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = F.when(F.col("id") % 3 == 0, "cpc").when(F.col("id") % 3 == 1, "CPM").otherwise("CPD")
    return channels(spark, sf_dir).select("id", K.query_key([F.col("g"), F.col("a"), F.col("si")], pm).alias("k"))


@query("SELECT o_orderkey, lower(trim(replace(o_orderpriority, '-', ''))) AS plain FROM orders")
def strip_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit(' "'), F.translate("o_orderpriority", "-", ""), F.lit("&amp;'\n "))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.sanitized(dirty).alias("plain"))


# 2.9 Arrays, maps, JSON, documents -------------------------------------------------------------------------------------
@query(f"""
WITH {FACT_SQL},
f AS (SELECT uckey, day, hour, price_cat, max(cnt) AS n
FROM fact GROUP BY ALL) SELECT uckey, day, hour, string_agg(price_cat || ':' || n, ','
ORDER BY price_cat) AS counts FROM f GROUP BY ALL""")
def count_array_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of 'price:count', smaller counts first, so that of a price that comes twice the larger stays."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("cnt", "price_cat"))), lambda s: F.concat_ws(":", s["price_cat"], s["cnt"].cast("string")))
    m = fact(spark, sf_dir).groupBy("uckey", "day", "hour").agg(rows.alias("c")).select("uckey", "day", "hour", Z.pairs_to_map(F.col("c")).alias("m"))
    return m.select("uckey", "day", "hour", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("counts"))


@query("SELECT o_orderkey, '1:' || CAST(trunc(o_totalprice) AS BIGINT) AS count_array, 0 AS hour FROM orders")
def single_count_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array(F.concat(F.lit("1:"), F.col("o_totalprice").cast("long").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(c, ",").alias("count_array"), F.lit(0).alias("hour"))


@query(f"WITH {SERIES_SQL} SELECT {_KEY}, array_to_string(list_transform(ts, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS ts FROM series")
def densify_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.daily_counts(fact(spark, sf_dir).withColumn("y", F.year("day")), day="y")
    return S.collected_series(counts, F.array(*[F.lit(y) for y in YEARS]), day="y").select("uckey", "price_cat", text_of("ts").alias("ts"))


@query(f"""
WITH {LOGS_SQL},
d AS (SELECT aid, CAST(day AS DATE) AS day, count(*) AS n
FROM logs GROUP BY ALL),
b AS (SELECT aid, CAST(unnest(range(CAST(min(day) AS TIMESTAMP), CAST(max(day) + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
FROM d GROUP BY aid) SELECT b.aid, b.day, coalesce(n, 0) AS n
FROM b LEFT JOIN d ON b.aid = d.aid AND b.day = d.day""")
def gap_fill_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logs(spark, sf_dir).groupBy("aid", F.to_date("day").alias("day")).agg(F.count("*").alias("n"))
    every = d.groupBy("aid").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return every.join(d, ["aid", "day"], "left").select("aid", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {SERIES_SQL} SELECT {_KEY}, {_JOIN.format('ts', 'coalesce(x, 0)')} AS ts FROM series")
def zero_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("ts", Z.zero_filled(F.col("ts"))).select("uckey", "price_cat", text_of("ts").alias("ts"))


_MED = "CAST(floor(coalesce(list_median(list_filter(ts, lambda x: x <> 0)), 0)) AS BIGINT)"


@query(f"WITH {SERIES_SQL} SELECT {_KEY}, {_JOIN.format('ts', f'CASE WHEN coalesce(x, 0) = 0 THEN {_MED} ELSE x END')} AS ts FROM series")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("ts", Z.imputed_with_median(F.col("ts"))).select("uckey", "price_cat", text_of("ts").alias("ts"))


@query(f"WITH {SERIES_SQL} SELECT {_KEY}, round(list_median(list_filter(ts, lambda x: x IS NOT NULL)), 6) AS m FROM series")
def series_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("uckey", "price_cat", F.round(Z.median(F.col("ts")), 6).alias("m"))


@query("""
SELECT p_partkey, CAST(p_type = 'ECONOMY' AS INT) AS t_1, CAST(p_type = 'PROMO' AS INT) AS t_2, CAST(p_type = 'NONE' AS INT) AS t_3
FROM part""")
def ohe_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(f"t_{i}") for i, c in enumerate(Z.one_hot(F.col("p_type"), ["ECONOMY", "PROMO", "NONE"]), 1)])


@query(f"WITH {SCORES_SQL} SELECT aid, " + ", ".join(f"round(coalesce(max(v) FILTER (keyword = 'kw{i}'), 0), 6) AS s{i}" for i in (1, 5, 9)) + " FROM s GROUP BY 1")
def ohe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("aid", *[F.round(F.coalesce(F.try_element_at("kws", F.lit(f"kw{i}")), F.lit(0.0)), 6).alias(f"s{i}") for i in (1, 5, 9)])


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey % 10 AS VARCHAR) AS v FROM part")
def vector_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 10).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ",").alias("v"))


@query(f"WITH {SCORES_SQL} SELECT aid, keyword, round(v, 6) AS v FROM s")
def explode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("aid", F.explode("kws").alias("keyword", "v")).withColumn("v", F.round("v", 6))


_TEXTS = f"""
{COUNTS_SQL},
i AS (SELECT aid, interval, string_agg(kwi || ':' || shows, ',' ORDER BY kwi) AS s
FROM c GROUP BY ALL),
t AS (SELECT aid, list(s ORDER BY interval DESC) AS l
FROM i GROUP BY 1)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aid, l: each interval's 'kwi:shows' pairs as text, newest first."""
    t = L.timeline(L.click_show_counts(daily_logs(spark, sf_dir), ["aid", "interval", "kwi"]))
    return t.select("aid", F.split(L.timeline_text("shows"), " ").alias("l"))


@query(f"""
WITH {_TEXTS} SELECT aid, array_to_string(list_transform(l, lambda s: array_to_string(list_transform(string_split(s, ','), lambda p: split_part(p, ':', 1)), '+')), ' ') AS keys
FROM t""")
def kw_count_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.transform("l", lambda s: F.transform(F.split(s, ","), lambda p: F.substring_index(p, ":", 1).cast("int")))
    return texts(spark, sf_dir).select("aid", parsed.alias("k")).select("aid", F.array_join(F.transform("k", lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), "+")), " ").alias("keys"))


@query(f"""
WITH {_TEXTS} SELECT aid, array_to_string(list_transform(flatten(list_transform(l[3:5], lambda s: string_split(s, ','))),
  lambda p: split_part(p, ':', 1)), ',') AS history
FROM t""")
def flatten_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.transform("l", lambda s: F.transform(F.split(s, ","), lambda p: F.substring_index(p, ":", 1)))
    return texts(spark, sf_dir).select("aid", F.array_join(F.flatten(F.slice(parsed, 3, 3)), ",").alias("history"))


@query(f"""
WITH {_TEXTS} SELECT aid, array_to_string(list_concat(list_transform(l, lambda s: CAST(len(string_split(s, ',')) AS VARCHAR)),
  list_transform(range(greatest(32 - len(l), 0)), lambda i: '0')), ',') AS padded
FROM t""")
def pad_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform("l", lambda s: F.size(F.split(s, ",")))
    return texts(spark, sf_dir).select("aid", Z.padded(sizes, 32).alias("p")).select("aid", F.array_join(F.col("p").cast("array<string>"), ",").alias("padded"))


@query(f"""
WITH {_TEXTS},
e AS (SELECT aid, unnest(flatten(list_transform(l, lambda s: string_split(s, ',')))) AS p
FROM t) SELECT aid, split_part(p, ':', 1) AS k, CAST(sum(CAST(split_part(p, ':', 2) AS BIGINT)) AS BIGINT) AS n
FROM e GROUP BY ALL""")
def str_to_map_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = texts(spark, sf_dir).select("aid", F.explode(F.flatten(F.transform("l", lambda s: F.split(s, ",")))).alias("p"))
    return e.groupBy("aid", F.substring_index("p", ":", 1).alias("k")).agg(F.sum(F.substring_index("p", ":", -1).cast("long")).alias("n"))


@query(f"""
WITH {SCORES_SQL},
k AS (SELECT DISTINCT keyword FROM s),
u AS (SELECT DISTINCT aid FROM s) SELECT u.aid, string_agg(printf('%.4f', coalesce(v, 0)), ','
ORDER BY k.keyword) AS vector FROM u CROSS
JOIN k LEFT JOIN s ON s.aid = u.aid AND s.keyword = k.keyword
GROUP BY 1""")
def score_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the sorted keywords goes to every task."""
    m = scores(spark, sf_dir)
    keys = logs(spark, sf_dir).agg(F.sort_array(F.collect_set("keyword")).alias("keys"))
    v = F.transform("keys", lambda k: F.format_string("%.4f", F.coalesce(F.try_element_at("kws", k), F.lit(0.0))))
    return m.crossJoin(F.broadcast(keys)).select("aid", F.array_join(v, ",").alias("vector"))


@query(f"""
WITH {SCORES_SQL} SELECT aid, string_agg(keyword || '/' || CAST(trunc(v * 100) AS INT) % 100, ','
ORDER BY keyword) AS buckets FROM s GROUP BY 1""")
def keyword_score_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.transform_values("kws", lambda k, v: F.struct(v.alias("v"), ((v * 100).cast("int") % 100).alias("b")))
    m = scores(spark, sf_dir).select("aid", b.alias("kws"))
    back = F.from_json(F.to_json("kws"), "map<string, struct<v: double, b: int>>")
    return m.select("aid", F.array_join(F.transform(F.array_sort(F.map_keys(back)), lambda k: F.concat_ws("/", k, F.try_element_at(back, k)["b"].cast("string"))), ",").alias("buckets"))


@query(f"WITH {FACT_SQL} SELECT DISTINCT uckey, '{{\"si\":\"' || split_part(uckey, ',', 2) || '\",\"g\":\"' || split_part(uckey, ',', 4) || '\",\"slots\":[\"' || split_part(uckey, ',', 2) || '\"]}}' AS doc FROM fact")
def traffic_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("uckey")
    return fact(spark, sf_dir).select("uckey").distinct().select("uckey", F.to_json(F.struct(K.part(k, 1).alias("si"), K.part(k, 3).alias("g"), F.array(K.part(k, 1)).alias("slots"))).alias("doc"))


@query(f"""
WITH {FACT_SQL} SELECT uckey, CAST(sum(cnt) AS BIGINT) AS total, CAST(sum(cnt) FILTER (price_cat = '3') AS BIGINT) AS high
FROM fact GROUP BY 1""")
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fact(spark, sf_dir).groupBy("uckey", "price_cat").agg(F.sum("cnt").alias("n")).groupBy("uckey").agg(F.map_from_entries(F.collect_list(F.struct("price_cat", "n"))).alias("m"))
    return m.select("uckey", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.try_element_at("m", F.lit("3")).alias("high"))


_HOURS = ", ".join(f"({i}, {p})" for i, p in enumerate(M.HOUR_PERCENT))


def hours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(M.HOUR_PERCENT)), "h int, percent double")


@query(f"""
WITH {FACT_SQL},
d AS (SELECT day, sum(cnt) AS n FROM fact
GROUP BY 1), hh(h, percent) AS (VALUES {_HOURS}) SELECT day, h, round(CAST(n * percent / 100 AS DOUBLE), 4) AS n
FROM d CROSS JOIN hh""")
def hour_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's count over 24 fixed percentages: an array of 24, exploded."""
    d = fact(spark, sf_dir).groupBy("day").agg(F.sum("cnt").alias("n"))
    return d.select("day", "n", F.posexplode(F.array(*[F.lit(p) for p in M.HOUR_PERCENT])).alias("h", "percent")).select("day", "h", F.round(F.col("n") * F.col("percent") / 100, 4).alias("n"))


@query(f"""
WITH {INVENTORY_SQL},
d AS (SELECT m, si, t, g, a, r, day, string_agg(hour || ':' || h0 || '/' || h1 || '/' || h2 || '/' || h3 || '=' || (h0 + h1 + h2 + h3),
  ' ' ORDER BY hour) AS s
FROM inv GROUP BY ALL) SELECT m || ',' || si || ',' || t || ',' || g || ',' || a || ',' || r AS uckey, string_agg(day || ' ' || s, ';'
ORDER BY day) AS doc FROM d GROUP BY ALL""")
def ucdoc_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested document of a key (day -> hours -> h0..h3, total) as JSON, read back and told in short."""
    from tidemark.operators.inventory import inventory_documents

    docs = inventory_documents(inventory(spark, sf_dir), ["m", "si", "t", "g", "a", "r"])
    schema = "uckey string, predictions array<struct<day: string, hours: array<struct<hour: int, h0: long, h1: long, h2: long, h3: long, total: long>>>>"
    d = docs.select(F.from_json("body", schema).alias("d")).select("d.*")
    hour = lambda h: F.concat(h["hour"].cast("string"), F.lit(":"), F.concat_ws("/", *[h[f"h{i}"].cast("string") for i in range(4)]), F.lit("="), h["total"].cast("string"))
    return d.select("uckey", F.array_join(F.transform("predictions", lambda p: F.concat_ws(" ", p["day"], F.array_join(F.transform(p["hours"], hour), " "))), ";").alias("doc"))


@query(f"WITH {INVENTORY_SQL} SELECT si, hour, " + ", ".join(f"round(avg(h{i}), 6) AS h{i}" for i in range(4)) + ", round(coalesce(sum(h0) / nullif(CAST(sum(h3) AS DOUBLE), 0), 0), 6) AS ratio FROM inv GROUP BY ALL")
def uchour_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).groupBy("si", "hour").agg(*[F.round(F.avg(f"h{i}"), 6).alias(f"h{i}") for i in range(4)], F.round(M.safe_ratio(F.sum("h0"), F.sum("h3").cast("double")), 6).alias("ratio"))


@query(f"""
WITH {CHANNELS_SQL} SELECT array_to_string(list_sort(list_distinct(flatten(list(a)))), ',') AS a,
  array_to_string(list_sort(list_distinct(flatten(list(si)))), ',') AS si
FROM tc""")
def union_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels(spark, sf_dir).agg(*[F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",").alias(c) for c in ("a", "si")])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS si, CAST(p_size AS VARCHAR) AS a FROM part")
def normalize_targeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose attributes are a scalar, a list, null or 'null': always lists, absent ones empty."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.lit('{"si":"null","a":["')).when(F.col("p_size") % 3 == 1, F.concat(F.lit('{"si":"'), "p_brand", F.lit('","a":["'))).otherwise(F.concat(F.lit('{"si":["'), "p_brand", F.lit('"],"a":["'))).alias("head"), "p_size")
    docs = p.select("p_partkey", F.concat("head", F.col("p_size").cast("string"), F.lit('"]}')).alias("body"))

    def listed(name: str):
        raw = F.get_json_object("body", f"$.{name}")
        many = F.from_json(raw, "array<string>")
        return F.when(raw.isNull() | (raw == "null"), F.array().cast("array<string>")).when(raw.startswith("["), many).otherwise(F.array(raw))

    return docs.select("p_partkey", F.array_join(listed("si"), ",").alias("si"), F.array_join(listed("a"), ",").alias("a"))


@query("SELECT c_custkey, sha256(c_mktsegment || ',' || c_nationkey) AS k FROM customer")
def tbr_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(K.joined_key(F.col("c_mktsegment"), F.col("c_nationkey")), 256).alias("k"))


@query(f"""
WITH {FACT_SQL},
s AS (SELECT uckey, price_cat, CAST(sum(cnt) AS BIGINT) AS n
FROM fact GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY uckey ORDER BY price_cat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM s) SELECT uckey, price_cat, CAST(greatest(least(n, 300 - before), 0) AS BIGINT) AS kept, CAST(n - greatest(least(n, 300 - before),
  0) AS BIGINT) AS moved
FROM r""")
def split_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allocation map, cut so that what is kept comes to 300 at most, entries in key order."""
    s = fact(spark, sf_dir).groupBy("uckey", "price_cat").agg(F.sum("cnt").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("uckey").orderBy("price_cat").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.greatest(F.least(F.col("n"), 300 - before), F.lit(0))
    return s.select("uckey", "price_cat", kept.alias("kept"), (F.col("n") - kept).alias("moved"))


# 2.10 Numbers and series -----------------------------------------------------------------------------------------------
@query(f"WITH {SERIES_SQL} SELECT {_KEY}, {IMP} AS imp, round({IMP} / 7.0, 6) AS p FROM series")
def imp_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("uckey", "price_cat", Z.total(F.col("ts")).alias("imp"), F.round(Z.popularity(F.col("ts")), 6).alias("p"))


@query("""
SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) AS p_size_n,
  round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS p_retailprice_n
FROM part""")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = S.zscores(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return z.select("p_partkey", F.round("p_size_n", 6).alias("p_size_n"), F.round("p_retailprice_n", 6).alias("p_retailprice_n"))


@query(f"""
WITH {LOGS_SQL},
d AS (SELECT day, CASE WHEN isodow(CAST(day AS DATE)) >= 6 THEN 1.0 ELSE 0.0 END AS w
FROM (SELECT DISTINCT day FROM logs)) SELECT day, round(CAST((w - (SELECT avg(w) FROM d)) / (SELECT stddev_samp(w) FROM d) AS DOUBLE), 6) AS w_n
FROM d""")
def list_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logs(spark, sf_dir).select("day").distinct().withColumn("w", F.when(F.weekday(F.to_date("day")) >= 5, 1.0).otherwise(0.0))
    return S.zscores(d, ["w"]).select("day", F.round("w_n", 6).alias("w_n"))


@query(f"""
WITH {SERIES_SQL} SELECT {_KEY}, round(list_sum(list_transform(ts, lambda x: ln(1 + coalesce(x, 0)))), 6) AS log_sum,
  {_JOIN.format('ts', 'coalesce(x, 0)')} AS back
FROM series""")
def log1p_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("uckey", "price_cat", Z.log_series(F.col("ts")).alias("l"))
    return s.select("uckey", "price_cat", F.round(F.aggregate("l", F.lit(0.0), lambda a, x: a + x), 6).alias("log_sum"), F.array_join(F.transform("l", lambda x: F.round(F.expm1(x)).cast("long").cast("string")), ",").alias("back"))


_LOW = "coalesce(list_avg(list_filter(ts, lambda x: x <> 0)), 0) / 1.5"


@query(f"WITH {SERIES_SQL} SELECT {_KEY}, {_JOIN.format('ts', f'CASE WHEN x > {_LOW} THEN x ELSE 0 END')} AS ts FROM series")
def denoise_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("ts", Z.denoised(F.col("ts"), 1.5)).select("uckey", "price_cat", text_of("ts").alias("ts"))


def _medians_sql(x: str, w: str) -> str:
    """Centered medians of w of the seven points of list x, taken from the nearest full window at the ends."""
    centre = f"greatest(least(i, 7 - (({w}) - 1) // 2), 1 + ({w}) // 2)"
    return f"list_transform(range(1, 8), lambda i: list_aggregate({x}[{centre} - ({w}) // 2 : {centre} + (({w}) - 1) // 2], 'median'))"


def _hampel_sql(sigmas: float) -> str:
    """Tables z (x, the series with zeros) and o (m, the medians; far; out) after it."""
    return f"""
m AS (SELECT *, {_medians_sql("x", "4")} AS m FROM z),
f AS (SELECT *, list_transform(range(1, 8), lambda i: abs(x[i] - m[i])) AS far FROM m),
d AS (SELECT *, {_medians_sql("far", "4")} AS mad FROM f),
o AS (SELECT *, list_transform(range(1, 8), lambda i: far[i] >= CAST({sigmas} AS DOUBLE) * CAST(1.4826 AS DOUBLE) * mad[i] AND far[i] > 0) AS out FROM d)"""


_ZEROED = f"{SERIES_SQL}, z AS (SELECT uckey, price_cat, list_transform(ts, lambda v: CAST(coalesce(v, 0) AS DOUBLE)) AS x FROM series)"
_HAMPEL = f"WITH {_ZEROED}, {_hampel_sql(1.5)}"
_OUTLIERS = "CAST(len(list_filter(out, lambda b: b)) AS INT) AS outliers"
_BAND = f"""WITH {_ZEROED},
b AS (SELECT *, greatest(list_aggregate(x, 'quantile_cont', 0.1), 4.0) AS lo, list_aggregate(x, 'quantile_cont', 0.9) AS hi, least(greatest(3, 2 * len(list_filter(x, lambda v: v = 0))), 7) AS w FROM z),
m AS (SELECT *, {_medians_sql("x", "w")} AS m FROM b)"""


@query(f"""
{_BAND} SELECT uckey, price_cat, array_to_string(list_transform(range(1, 8),
  lambda i: CAST(round(CASE WHEN x[i] BETWEEN lo AND hi THEN x[i] ELSE m[i] END, 4) AS VARCHAR)), ',') AS ts
FROM m""")
def denoise_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling windows depend on each series' zeros."""
    return series(spark, sf_dir).select("uckey", "price_cat", Z.denoised_band(F.col("ts"), 0.1, 0.9).alias("ts")).withColumn("ts", F.array_join(F.transform("ts", lambda x: F.round(x, 4).cast("string")), ","))


@query(f"{_HAMPEL} SELECT uckey, price_cat, {_OUTLIERS} FROM o")
def hampel_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("uckey", "price_cat", Z.hampel(F.col("ts"), 2, 1.5)["outliers"].alias("outliers"))


@query(f"""
{_HAMPEL} SELECT uckey, price_cat, array_to_string(list_transform(range(1, 8),
  lambda i: CAST(round(CASE WHEN out[i] THEN m[i] ELSE x[i] END, 4) AS VARCHAR)), ',') AS ts, {_OUTLIERS}
FROM o""")
def hampel_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = series(spark, sf_dir).select("uckey", "price_cat", Z.hampel(F.col("ts"), 2, 1.5).alias("h"))
    return h.select("uckey", "price_cat", F.array_join(F.transform("h.ts", lambda x: F.round(x, 4).cast("string")), ",").alias("ts"), "h.outliers")


_MENDED = ", ".join(
    "CAST(ts[1] AS DOUBLE) AS d1" if i == 1 else f"CAST(ts[{i}] AS DOUBLE) AS d{i}" if i == 7
    else f"CASE WHEN out[{i}] AND d{i - 1} IS NOT NULL AND ts[{i}] IS NOT NULL AND ts[{i + 1}] IS NOT NULL THEN (d{i - 1} + ts[{i + 1}]) / 2 ELSE CAST(ts[{i}] AS DOUBLE) END AS d{i}"
    for i in range(1, 8)
)


@query(
    f"WITH {SERIES_SQL}, t AS (SELECT unnest(range(1, 8)) AS pos, unnest(ts) AS n FROM series), z AS (SELECT list(CAST(n AS DOUBLE) ORDER BY pos) AS x FROM (SELECT pos, sum(coalesce(n, 0)) AS n FROM t GROUP BY 1)), {_hampel_sql(1.0)},"
    f" mended AS (SELECT uckey, price_cat, {_MENDED} FROM series, o)"
    " SELECT uckey, price_cat, array_to_string(list_transform([d1, d2, d3, d4, d5, d6, d7], lambda v: coalesce(CAST(round(v, 4) AS VARCHAR), '-')), ',') AS ts FROM mended"
)
def global_outlier_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = S.global_outlier_fix(series(spark, sf_dir), 2, 1.0)
    return fixed.select("uckey", "price_cat", F.array_join(F.transform("ts", lambda x: F.round(x, 4).cast("string")), ",", "-").alias("ts"))


@query(f"""
WITH {SERIES_SQL},
f AS (SELECT {_KEY}, list_transform(ts, lambda x: coalesce(x, 0) > 0) AS b
FROM series) SELECT {_KEY}, CAST(coalesce(list_position(b, true), 0) - 1 AS INT) AS first_ix, CAST(CASE WHEN list_contains(b,
  true) THEN 7 - list_position(list_reverse(b), true) ELSE -1 END AS INT) AS last_ix
FROM f""")
def series_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("uckey", "price_cat", Z.first_active(F.col("ts")).alias("first_ix"), Z.last_active(F.col("ts")).alias("last_ix"))


@query(f"""
WITH {SERIES_SQL},
f AS (SELECT {_KEY}, list_transform(ts, lambda x: coalesce(x, 0) > 0) AS b
FROM series) SELECT {_KEY} FROM f WHERE (7 - list_position(list_reverse(b), true) - (list_position(b, true) - 1)) / 7.0 >= 0.7""")
def drop_short_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return series(spark, sf_dir).where((Z.last_active(ts) - Z.first_active(ts)) / F.size(ts) >= 0.7).select("uckey", "price_cat")


def _corr(k: int) -> str:
    return f"CASE WHEN var_pop(y) FILTER (pos < 7 - {k}) > 0 AND var_pop(y{k}) FILTER (pos < 7 - {k}) > 0 THEN corr(y, y{k}) FILTER (pos < 7 - {k}) END"


@query(f"""
WITH {SERIES_SQL},
x AS (SELECT {_KEY}, unnest(range(7)) AS pos, CAST(coalesce(unnest(ts), 0) AS DOUBLE) AS y
FROM series),
l AS (SELECT *, lead(y, 1) OVER w AS y1, lead(y, 2) OVER w AS y2, lead(y, 3) OVER w AS y3
FROM x WINDOW w AS (PARTITION BY {_KEY} ORDER BY pos)) SELECT {_KEY}, round(0.5 * {_corr(2)} + 0.25 * {_corr(1)} + 0.25 * {_corr(3)}, 6) AS r
FROM l GROUP BY {_KEY}""")
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("uckey", "price_cat", F.round(Z.autocorrelation(F.col("ts"), 2), 6).alias("r"))


@query(f"""
WITH {LOGS_SQL},
d AS (SELECT DISTINCT CAST(day AS DATE) AS day
FROM logs),
i AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS ix
FROM d) SELECT i.day, i.ix, coalesce(a.ix, -1) AS lag7, coalesce(b.ix, -1) AS lag_month
FROM i LEFT JOIN i a ON a.day = i.day - 7
LEFT JOIN i b ON b.day = CAST(i.day - INTERVAL 1 MONTH AS DATE)""")
def lag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.indexing import dense_index

    i = dense_index(logs(spark, sf_dir).select(F.to_date("day").alias("day")), "day", first=0, into="ix")
    a, b = i.select(F.date_add("day", 7).alias("day"), F.col("ix").alias("lag7")), i.select(F.col("day").alias("m"), F.col("ix").alias("lag_month"))
    return i.join(a, "day", "left").withColumn("m", F.add_months("day", -1)).join(b, "m", "left").select("day", "ix", F.coalesce("lag7", F.lit(-1)).alias("lag7"), F.coalesce("lag_month", F.lit(-1)).alias("lag_month"))


@query(f"""
WITH {LOGS_SQL},
d AS (SELECT keyword, day, count(*) AS n FROM logs
GROUP BY ALL),
s AS (SELECT avg(n) AS m, stddev_pop(n) AS sd
FROM d) SELECT keyword, day, round((coalesce(lag(n, 7) OVER (PARTITION BY keyword ORDER BY day), 0) - m) / sd, 6) AS lag7
FROM d, s""")
def lagged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logs(spark, sf_dir).groupBy("keyword", "day").agg(F.count("*").alias("n"))
    s = d.agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"))  # one row
    lag = F.coalesce(F.lag("n", 7).over(Window.partitionBy("keyword").orderBy("day")), F.lit(0))
    return d.crossJoin(F.broadcast(s)).select("keyword", "day", F.round((lag - F.col("m")) / F.col("sd"), 6).alias("lag7"))


@query("""
WITH o AS (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0 END AS a, CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE 0 END AS b
FROM part) SELECT p_partkey, round(CAST((a - (SELECT avg(a) FROM o)) / (SELECT stddev_samp(a) FROM o) AS DOUBLE), 6) AS a_n,
  round(CAST((b - (SELECT avg(b) FROM o)) / (SELECT stddev_samp(b) FROM o) AS DOUBLE), 6) AS b_n
FROM o""")
def standardized_ohe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = Z.one_hot(F.col("p_type"), ["ECONOMY", "PROMO"])
    z = S.zscores(table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b")), ["a", "b"])
    return z.select("p_partkey", F.round("a_n", 6).alias("a_n"), F.round("b_n", 6).alias("b_n"))


@query(f"""
WITH {SERIES_SQL},
m AS (SELECT {_KEY}, list_median(list_transform(ts, lambda x: coalesce(x, 0))) AS md
FROM series) SELECT {_KEY}, round((md - (SELECT avg(md) FROM m)) / (SELECT stddev_samp(md) FROM m), 6) AS md_n
FROM m""")
def median_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = series(spark, sf_dir).select("uckey", "price_cat", Z.median(Z.zero_filled(F.col("ts"))).alias("md"))
    return S.zscores(m, ["md"]).select("uckey", "price_cat", F.round("md_n", 6).alias("md_n"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS c1 FROM embeddings")
def self_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(Z.dot(F.col("embedding"), F.col("embedding")), 5).alias("c1"))


@query(f"""
WITH {SCORES_SQL},
n AS (SELECT aid, sqrt(sum(v * v)) AS n FROM s
GROUP BY 1) SELECT s.aid, keyword, round(v / nullif(n, 0), 6) AS v
FROM s JOIN n ON s.aid = n.aid""")
def l2_normalize_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("aid", F.explode(Z.unit_map(F.col("kws"))).alias("keyword", "v")).withColumn("v", F.round("v", 6))


_PAIR = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
FROM embeddings),
p AS (SELECT a.vec_id, a.e AS x, b.e AS y
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"""
WITH {_PAIR} SELECT vec_id, round(8 - sqrt(greatest(list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y), 0)), 5) AS s
FROM p""")
def euclid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).select("vec_id", F.round(Z.euclid_similarity(F.col("x"), F.col("y"), 64), 5).alias("s"))


@query(f"WITH {_PAIR} SELECT vec_id, round(1 - list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 5) AS d FROM p")
def cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).select("vec_id", F.round(Z.cosine_distance(F.col("x"), F.col("y")), 5).alias("d"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(range(64), lambda i: e[i + 1] * (((i * 7 + {j} * 3) % 5) - 2))), 5) AS y{j}" for j in range(3)) + " FROM v")
def vector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row vectors times a 64 x 3 matrix of parameters."""
    matrix = [[float((i * 7 + j * 3) % 5 - 2) for i in range(64)] for j in range(3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(Z.dot(F.col("embedding"), F.array(*[F.lit(x) for x in column])), 5).alias(f"y{j}") for j, column in enumerate(matrix)])


@query("""
SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_discount) / nullif(sum(CASE WHEN l_linestatus = 'F' THEN l_tax ELSE 0 END), 0), 0), 6) AS r
FROM lineitem GROUP BY ALL""")
def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(M.safe_ratio(F.sum("l_discount"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_tax")).otherwise(0.0))), 6).alias("r"))


_AP = f"""
{SERIES_SQL},
ap AS (SELECT {_KEY}, CAST(coalesce(ts[7], 0) AS DOUBLE) AS actual, CAST(coalesce(ts[6], 0) AS DOUBLE) AS predicted
FROM series)"""


def actual_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last year against the year before, as a forecast."""
    point = lambda i: F.coalesce(F.try_element_at("ts", F.lit(i)), F.lit(0)).cast("double")
    return series(spark, sf_dir).select("uckey", "price_cat", point(7).alias("actual"), point(6).alias("predicted"))


@query(f"WITH {_AP} SELECT {_KEY}, CASE WHEN actual = 0 THEN -1 ELSE round(abs(actual - predicted) / actual, 3) END AS error FROM ap")
def relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actual_predicted(spark, sf_dir).select("uckey", "price_cat", M.relative_error(F.col("actual"), F.col("predicted")).alias("error"))


@query(f"""
WITH {_AP} SELECT round(avg(CASE WHEN actual + predicted < 0.01 THEN 0 ELSE 2 * abs(predicted - actual) / (actual + predicted) END), 6) AS smape,
  round(avg(abs(predicted - actual)), 6) AS mae
FROM ap WHERE actual <> 0""")
def smape(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = actual_predicted(spark, sf_dir).where("actual <> 0")
    return ap.agg(F.round(F.avg(M.smape_term(F.col("actual"), F.col("predicted"))), 6).alias("smape"), F.round(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 6).alias("mae"))


@query("""
WITH x AS (SELECT l.quality AS y, d.n_chars AS s
FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r
FROM x),
a AS (SELECT sum(y) AS p, count(*) - sum(y) AS q, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rs
FROM r) SELECT round(CAST((rs - p * (p + 1) / 2.0) / (p * q) AS DOUBLE), 6) AS auc
FROM a""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return L.auc(x, "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


@query(f"""
WITH {LOGS_SQL} SELECT aid, keyword, round(coalesce(CAST(sum(is_click) AS DOUBLE) / nullif(count(*) FILTER (is_click = 0), 0), 0), 6) AS ctr
FROM logs WHERE sec BETWEEN 1704412800 AND 1705881600
GROUP BY ALL""")
def ctr_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rates(logs(spark, sf_dir).where(F.col("sec").between(1704412800, 1705881600)), ["aid", "keyword"]).select("aid", "keyword", F.round("ctr", 6).alias("ctr"))


_DAILY = f"""
{LOGS_SQL},
d AS (SELECT keyword, day, CAST(count(*) AS DOUBLE) AS n
FROM logs GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY day) - 1 AS i
FROM d)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logs(spark, sf_dir).groupBy("keyword", "day").agg(F.count("*").cast("double").alias("n"))
    return d.withColumn("i", F.row_number().over(Window.partitionBy("keyword").orderBy("day")) - 1)


@query(f"WITH {_DAILY} SELECT keyword, round(regr_intercept(n, i) + 5 * regr_slope(n, i), 6) AS next FROM y WHERE i < 5 GROUP BY 1")
def linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line through the first five days, at the sixth."""
    return daily(spark, sf_dir).where("i < 5").groupBy("keyword").agg(F.round(F.regr_intercept("n", "i") + 5 * F.regr_slope("n", "i"), 6).alias("next"))


@query(f"""
WITH {_DAILY} SELECT keyword, day, round(avg(n) OVER (PARTITION BY keyword ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean
FROM y""")
def trailing_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("keyword").orderBy("i").rowsBetween(-6, 0)
    return daily(spark, sf_dir).select("keyword", "day", F.round(F.avg("n").over(w), 6).alias("mean"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE CASE c_mktsegment WHEN 'BUILDING' THEN CASE WHEN c_acctbal / 200 <= 12 THEN 1 WHEN c_acctbal / 200 <= 25 THEN 2 ELSE 3 END WHEN 'MACHINERY' THEN CASE WHEN c_acctbal / 200 <= 0.7 THEN 1 WHEN c_acctbal / 200 <= 2 THEN 2 ELSE 3 END ELSE 3 END END AS category
FROM customer""")
def price_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("c_mktsegment") == "BUILDING", "CPM").when(F.col("c_mktsegment") == "MACHINERY", "CPC").otherwise("NONE")
    return table(spark, sf_dir, "customer").select("c_custkey", M.price_category(F.col("c_acctbal") / 200, model).alias("category"))


_INVKEY = "m, si, t, g, a, r, day, hour"


@query(f"WITH {INVENTORY_SQL} SELECT {_INVKEY}, " + ", ".join(f"greatest(h{i} * 2 - h{(i + 1) % 4}, 0) AS h{i}" for i in range(4)) + " FROM inv")
def impression_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select(*_INVKEY.split(", "), *[F.greatest(F.col(f"h{i}") * 2 - F.col(f"h{(i + 1) % 4}"), F.lit(0)).alias(f"h{i}") for i in range(4)])


@query(f"""
WITH {INVENTORY_SQL} SELECT {_INVKEY}, CASE hour % 4 WHEN 0 THEN h0 WHEN 1 THEN h0 + h1 WHEN 2 THEN h0 + h1 + h2 ELSE h0 + h1 + h2 + h3 END AS n
FROM inv""")
def count_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select(*_INVKEY.split(", "), M.up_to_category([F.col(h) for h in M.H], F.col("hour") % 4).alias("n"))


@query(f"""
WITH {INVENTORY_SQL} SELECT {_INVKEY}, h0 - greatest(least(h0, 30), 0) AS h0, h1 - greatest(least(h1, 30 - h0), 0) AS h1, h2 - greatest(least(h2,
  30 - h0 - h1), 0) AS h2, h3 - greatest(least(h3, 30 - h0 - h1 - h2), 0) AS h3
FROM inv""")
def subtract_booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = M.after_booked([F.col(h) for h in M.H], F.lit(30))
    return inventory(spark, sf_dir).select(*_INVKEY.split(", "), *[c.alias(h) for c, h in zip(left, M.H)])


@query(f"""
WITH {_RANGES}, hh(h, percent) AS (VALUES {_HOURS}) SELECT id, strftime(t, '%Y-%m-%d') AS day,
  CASE WHEN count(*) >= 24 THEN 1 ELSE round(CAST(sum(percent) / 100 AS DOUBLE), 6) END AS share
FROM p JOIN hh ON h = hour(t) GROUP BY id, strftime(t, '%Y-%m-%d')""")
def hour_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ranges(spark, sf_dir).groupBy("id", C.day_of(F.col("t")).alias("day")).agg(F.array_sort(F.collect_list(F.hour("t"))).alias("hours"))
    return g.select("id", "day", F.round(M.hour_share(F.col("hours")), 6).alias("share"))


@query("""
WITH pop AS (SELECT n_nationkey AS city, n_regionkey AS r, n_nationkey * 10 + 5 AS p
FROM nation),
s AS (SELECT r, p, city, CAST(p AS DOUBLE) / sum(p) OVER (PARTITION BY r) AS x
FROM pop),
q AS (SELECT r, round(sum(x), 6) AS ratio
FROM s WHERE city % 2 = 0 GROUP BY 1) SELECT ratio, string_agg(CAST(r AS VARCHAR), ','
ORDER BY r) AS regions FROM q GROUP BY 1""")
def region_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen cities' share of their region's people; regions of equal shares together."""
    pop = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city"), F.col("n_regionkey").alias("r"), (F.col("n_nationkey") * 10 + 5).alias("p"))
    share = pop.join(pop.groupBy("r").agg(F.sum("p").alias("all")), "r").where("city % 2 = 0").groupBy("r").agg(F.round(F.sum(F.col("p") / F.col("all")), 6).alias("ratio"))
    return share.groupBy("ratio").agg(F.array_join(F.array_sort(F.collect_list("r")).cast("array<string>"), ",").alias("regions"))


@query(f"""
WITH {TBR_SQL},
s AS (SELECT a, g, CAST(sum(CASE WHEN list_contains(string_split(ai, '-'), 'ai1') THEN n ELSE 0 END) AS DOUBLE) AS x, CAST(sum(n) AS DOUBLE) AS y
FROM tbr GROUP BY ALL) SELECT a, g, round(CASE WHEN abs(x - y) <= 0.001 THEN 1 WHEN x = 0 THEN 0 ELSE x / y END, 6) AS ratio
FROM s""")
def average_tbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.array_contains(F.split("ai", "-"), "ai1"), F.col("n")).otherwise(0)
    s = behaviour(spark, sf_dir).groupBy("a", "g").agg(F.sum(hit).cast("double").alias("x"), F.sum("n").cast("double").alias("y"))
    return s.select("a", "g", F.round(M.behaviour_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


@query(f"WITH {INVENTORY_SQL}, d AS (SELECT si, day, " + ", ".join(f"sum(h{i}) AS h{i}" for i in range(4)) + " FROM inv GROUP BY ALL) SELECT si, day, CAST(h AS INT) AS hour, " + ", ".join(f"round(CAST(h{i} AS DOUBLE) / 24, 6) AS h{i}" for i in range(4)) + " FROM d CROSS JOIN (SELECT unnest(range(24)) AS h)")
def spread_day_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inventory(spark, sf_dir).groupBy("si", "day").agg(*[F.sum(h).alias(h) for h in M.H])
    return d.select("si", "day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), *[F.round(F.col(h) / 24, 6).alias(h) for h in M.H])
