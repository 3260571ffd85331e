"""Section 2.2: projections, filters, predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions import series as Z
from tidemark.operators import tables as T
from tidemark.operators.targeting import intersecting, match_channels
from tidemark.plans.inputs import BOOKINGS_SQL, CHANNELS_SQL, FACT_SQL, INVENTORY_SQL, LOGS_SQL, MATCH_SQL, SERIES_SQL, TBR_SQL, behaviour, bookings, channels, fact, inventory, logs, series, table, text_of
from tidemark.plans.registry import query

ATTRIBUTES = ["m", "si", "t", "g", "a", "r"]
_KEYS = "k AS (SELECT DISTINCT uckey FROM fact)"
TS_TEXT = "array_to_string(list_transform(ts, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',')"
NONZERO = "len(list_filter(ts, lambda x: x IS NOT NULL AND x <> 0))"
IMP = "CAST(coalesce(list_sum(ts), 0) AS BIGINT)"
H_SUM = ", ".join(f"CAST(sum(h{i}) AS BIGINT) AS h{i}" for i in range(4))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).select("uckey").distinct()


@query(f"""
WITH {FACT_SQL}, {_KEYS} SELECT uckey, split_part(uckey, ',', 2) AS si, split_part(uckey, ',', 7) AS r, split_part(uckey, ',', 9) AS missing
FROM k""")
def uckey_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("uckey")
    return keys(spark, sf_dir).select("uckey", K.part(k, 1).alias("si"), K.part(k, 6).alias("r"), K.part(k, 8).alias("missing"))


@query("""
SELECT c_custkey, coalesce(c_mktsegment, '') || ',' || c_nationkey || ',' || CASE WHEN c_acctbal < 0 THEN '' ELSE 'p' END AS uckey
FROM customer""")
def uckey_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", K.joined_key(F.col("c_mktsegment"), F.col("c_nationkey"), F.when(F.col("c_acctbal") >= 0, "p")).alias("uckey"))


@query(f"WITH {FACT_SQL}, {_KEYS} SELECT uckey, regexp_replace(uckey, '^((?:[^,]*,){{5}})[^,]*', '\\1') AS blanked FROM k")
def uckey_blank_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir).select("uckey", K.blank_part(F.col("uckey"), 5).alias("blanked"))


@query(f"WITH {FACT_SQL}, {_KEYS} SELECT uckey, regexp_replace(uckey, '^((?:[^,]*,){{5}})[^,]*,', '\\1') AS dropped FROM k")
def uckey_drop_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir).select("uckey", K.drop_part(F.col("uckey"), 5).alias("dropped"))


@query(f"""
WITH {FACT_SQL}, {_KEYS},
map AS (SELECT CAST(n_nationkey AS VARCHAR) AS old, n_name AS new
FROM nation WHERE n_nationkey < 3) SELECT uckey, CASE WHEN new IS NULL THEN uckey ELSE regexp_replace(uckey, '[^,]*$', new) END AS mapped
FROM k LEFT JOIN map ON split_part(uckey, ',', 7) = old""")
def remap_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("string").alias("old"), F.col("n_name").alias("new"))
    k = keys(spark, sf_dir).withColumn("old", K.part(F.col("uckey"), 6))
    return k.join(mapping, "old", "left").select("uckey", F.when(F.col("new").isNull(), F.col("uckey")).otherwise(K.replace_part(F.col("uckey"), 6, F.col("new"))).alias("mapped"))


@query(f"WITH {FACT_SQL} SELECT uckey, CAST(sum(cnt) AS BIGINT) AS n FROM fact WHERE split_part(uckey, ',', 2) IN ('slot1', 'slot3') GROUP BY 1")
def filter_slot_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).where(K.part(F.col("uckey"), 1).isin("slot1", "slot3")).groupBy("uckey").agg(F.sum("cnt").alias("n"))


@query(f"""
WITH {FACT_SQL} SELECT uckey, day, cnt FROM fact
WHERE split_part(uckey, ',', 1) = 'R' AND split_part(uckey, ',', 4) = 'F' AND split_part(uckey, ',', 5) = '2'""")
def filter_traffic_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("uckey")
    named = fact(spark, sf_dir).select("uckey", "day", "cnt", K.part(k, 0).alias("m"), K.part(k, 3).alias("g"), K.part(k, 4).alias("a"))
    return T.with_attributes(named, {"m": "R", "g": "F", "a": "2"}).select("uckey", "day", "cnt")


@query("SELECT doc_id, source FROM documents WHERE length(source) <> 0")
def filter_keyword_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.length("source") != 0).select("doc_id", "source")


@query(f"WITH {LOGS_SQL} SELECT event_id, aid, keyword FROM logs WHERE keyword IN ('kw1', 'kw4', 'kw7')")
def filter_keywords_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).where(F.col("keyword").isin("kw1", "kw4", "kw7")).select("event_id", "aid", "keyword")


@query(f"WITH {SERIES_SQL} SELECT uckey, price_cat, {IMP} AS imp FROM series WHERE {IMP} > 0")
def filter_positive_imp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("uckey", "price_cat", Z.total(F.col("ts")).alias("imp")).where("imp > 0")


@query(f"WITH {SERIES_SQL} SELECT uckey, price_cat, {IMP} AS imp FROM series WHERE {IMP} / 7.0 > 20 AND NOT ({NONZERO} < 0.4 * 7)")
def remove_weak_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.series import without_weak

    return without_weak(series(spark, sf_dir), 20.0, 0.4).select("uckey", "price_cat", "imp")


@query(f"WITH {SERIES_SQL} SELECT uckey, price_cat, NOT ({NONZERO} > 0.5 * 7 AND {IMP} / 7.0 >= 15) AS sparse FROM series")
def flag_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.series import is_sparse

    ts = F.col("ts")
    return series(spark, sf_dir).select("uckey", "price_cat", is_sparse(Z.popularity(ts), ts, 0.5, 15.0).alias("sparse"))


@query(f"""
WITH {SERIES_SQL},
p AS (SELECT *, {IMP} / 7.0 AS p FROM series),
g AS (SELECT avg(p) AS av FROM p) SELECT uckey, price_cat, p > av AND {NONZERO} < 0.6 * 7 AS spiked
FROM p, g""")
def flag_spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumn("p", Z.popularity(F.col("ts")))
    mean = s.agg(F.avg("p").alias("av"))  # one row
    return s.crossJoin(F.broadcast(mean)).select("uckey", "price_cat", ((F.col("p") > F.col("av")) & (F.size(Z.nonzero(F.col("ts"))) < 0.6 * F.size("ts"))).alias("spiked"))


@query(f"WITH {SERIES_SQL} SELECT uckey, price_cat FROM series WHERE 7 - {NONZERO} <= 2")
def filter_missing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).where(F.size("ts") - F.size(Z.nonzero(F.col("ts"))) <= 2).select("uckey", "price_cat")


@query(f"WITH {LOGS_SQL} SELECT aid, count(DISTINCT sec - sec % 86400) AS days FROM logs GROUP BY 1 HAVING count(DISTINCT sec - sec % 86400) > 10")
def filter_min_active_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("aid").agg(F.countDistinct(F.col("sec") - F.col("sec") % 86400).alias("days")).where("days > 10")


@query(f"""
WITH {LOGS_SQL},
s AS (SELECT DISTINCT aid FROM logs WHERE is_click = 1 AND keyword = 'kw1') SELECT aid, CAST(sum(is_click) AS BIGINT) AS clicks, aid IN (SELECT aid
FROM s) AS seed FROM logs GROUP BY 1""")
def filter_user_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs(spark, sf_dir)
    seeds = log.where("is_click = 1 and keyword = 'kw1'").select("aid").distinct()
    per = log.groupBy("aid").agg(F.sum("is_click").alias("clicks"))
    return per.join(seeds, "aid", "left_semi").withColumn("seed", F.lit(True)).unionByName(per.join(seeds, "aid", "left_anti").withColumn("seed", F.lit(False)))


@query(f"""
WITH {SERIES_SQL} SELECT uckey, price_cat, array_to_string(list_transform(ts, lambda x: CAST(coalesce(x, 0) AS VARCHAR)), ',') AS ts
FROM series""")
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("ts", Z.zero_filled(F.col("ts"))).select("uckey", "price_cat", text_of("ts").alias("ts"))


@query(f"WITH {INVENTORY_SQL}, {CHANNELS_SQL} SELECT tc.id, count(*) AS n FROM tc JOIN inv ON {MATCH_SQL} GROUP BY 1")
def predicate_single_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_channels(channels(spark, sf_dir), inventory(spark, sf_dir), ATTRIBUTES).groupBy("id").agg(F.count("*").alias("n"))


_SPLIT = "string_split(ai, '-')", "string_split(au, '-')"


@query(f"""
WITH {TBR_SQL} SELECT a, g, ai, au, day, n
FROM tbr WHERE list_has_any({_SPLIT[0]}, ['ai0', 'ai5']) AND NOT list_has_any({_SPLIT[1]}, ['au2'])""")
def predicate_multi_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    return behaviour(spark, sf_dir).where(T.any_of(F.split("ai", "-"), lit("ai0", "ai5")) & T.none_of(F.split("au", "-"), lit("au2")))


@query(f"""
WITH {TBR_SQL} SELECT a IN ('2', '5') AND g = 'O' AND list_has_any({_SPLIT[0]}, ['ai1']) AS multi, CAST(sum(n) AS BIGINT) AS n
FROM tbr WHERE a IN ('2', '5') AND g = 'O'
GROUP BY 1""")
def predicate_age_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.col("a").isin("2", "5") & (F.col("g") == "O")
    return behaviour(spark, sf_dir).where(people).groupBy((people & F.array_contains(F.split("ai", "-"), "ai1")).alias("multi")).agg(F.sum("n").alias("n"))


@query(f"""
WITH {INVENTORY_SQL} SELECT 'and' AS op, {H_SUM}
FROM inv WHERE (g = 'O' AND a IN ('1', '2')) AND (si = 'slot1')
UNION ALL SELECT 'or', {H_SUM} FROM inv WHERE (g = 'O' AND a IN ('1', '2')) OR si = 'slot1'
UNION ALL SELECT 'not', {H_SUM} FROM inv WHERE NOT (g = 'O' AND a IN ('1', '2'))""")
def predicate_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (F.col("g") == "O") & F.col("a").isin("1", "2"), F.col("si") == "slot1"
    inv = inventory(spark, sf_dir)
    each = F.explode(F.filter(F.array(F.when(one & two, "and"), F.when(one | two, "or"), F.when(~one, "not")), lambda x: x.isNotNull())).alias("op")
    return inv.select("*", each).groupBy("op").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)])


@query(f"""
WITH {INVENTORY_SQL} SELECT m, si, t, g, a, r, CAST(sum(h0 + h1 + h2 + h3) AS BIGINT) AS n
FROM inv WHERE (g IN ('O', 'F') AND t = 'F') AND (si IN ('slot1') OR a IN ('2', '3') OR r IN ('4'))
GROUP BY ALL""")
def predicate_ands_ors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of all `ands` must match; any attribute of any of `ors` is enough."""
    ands = [{"g": ["O", "F"]}, {"t": ["F"]}]
    ors = [{"si": ["slot1"], "a": ["2", "3"]}, {"r": ["4"], "a": ["3", "2"]}]
    must = reduce(lambda x, y: x & y, [F.col(k).isin(v) for b in ands for k, v in b.items()])
    may = reduce(lambda x, y: x | y, [F.col(k).isin(v) for b in ors for k, v in b.items()])
    return inventory(spark, sf_dir).where(must & may).groupBy(*ATTRIBUTES).agg(F.sum(F.expr("h0 + h1 + h2 + h3")).alias("n"))


@query(f"""
WITH {INVENTORY_SQL} SELECT m, si, t, g, a, r, day, CAST(sum(h0 + h1 + h2 + h3) AS BIGINT) AS n
FROM inv WHERE g IN ('O', 'F') AND NOT (si = 'slot1' OR a IN ('2', '3'))
GROUP BY ALL""")
def predicate_ands_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    minus = (F.col("si") == "slot1") | F.col("a").isin("2", "3")
    return inventory(spark, sf_dir).where(F.col("g").isin("O", "F") & ~minus).groupBy(*ATTRIBUTES, "day").agg(F.sum(F.expr("h0 + h1 + h2 + h3")).alias("n"))


USERS_SQL = f"""
{LOGS_SQL}, users AS (SELECT aid, day, list_sort(list_distinct(list(keyword))) AS kws FROM logs GROUP BY ALL)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's keywords on each day."""
    return logs(spark, sf_dir).groupBy("aid", "day").agg(F.sort_array(F.collect_set("keyword")).alias("kws"))


@query(f"""
WITH {USERS_SQL} SELECT aid FROM users WHERE day BETWEEN '2024-01-10' AND '2024-01-14'
GROUP BY aid HAVING bool_or(list_has_any(kws, ['kw1', 'kw2'])) AND bool_or(list_contains(kws, 'kw5')) AND NOT bool_or(list_contains(kws, 'kw9'))""")
def predicate_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each attribute, on any of the days any value matches; the excluded audience on none."""
    has = lambda *v: F.bool_or(F.arrays_overlap("kws", F.array(*[F.lit(x) for x in v])))
    per = users(spark, sf_dir).where(F.col("day").between("2024-01-10", "2024-01-14")).groupBy("aid").agg(has("kw1", "kw2").alias("x"), has("kw5").alias("y"), has("kw9").alias("z"))
    return per.where("x and y and not z").select("aid")


_SCORES = f"{LOGS_SQL}, s AS (SELECT aid, keyword, sum(is_click) / CAST(count(*) AS DOUBLE) AS v FROM logs GROUP BY ALL)"


@query(f"""
WITH {_SCORES} SELECT aid, CAST(trunc(v * 100) AS INT) % 100 AS b
FROM s WHERE keyword = 'kw3' AND CAST(trunc(v * 100) AS INT) % 100 BETWEEN 30 AND 80""")
def predicate_bucket_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs(spark, sf_dir).groupBy("aid", "keyword").agg((F.sum("is_click") / F.count("*")).alias("v"))
    kws = s.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("keyword", F.struct("v", ((F.col("v") * 100).cast("int") % 100).alias("b"))))).alias("kws"))
    b = F.try_element_at("kws", F.lit("kw3"))["b"]
    return kws.where(b.between(30, 80)).select("aid", b.alias("b"))


@query(f"WITH {BOOKINGS_SQL} SELECT g AS status, count(*) AS n FROM bookings GROUP BY g HAVING list_contains(list(bk_id), 'b1F')")
def predicate_map_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bookings(spark, sf_dir).groupBy(F.col("g")[0].alias("status")).agg(F.map_from_entries(F.collect_list(F.struct("bk_id", "amount"))).alias("allocated"), F.count("*").alias("n"))
    return b.where(F.map_contains_key("allocated", "b1F")).select("status", "n")


_CROSS = " AND ".join(f"(len(x.{c}) = 0 OR len(y.{c}) = 0 OR list_has_any(x.{c}, y.{c}))" for c in ("a", "g", "si", "t", "m"))


@query(f"WITH {CHANNELS_SQL} SELECT x.id AS a_id, y.id AS b_id, {_CROSS} AS meets FROM tc x JOIN tc y ON x.id < y.id")
def targeting_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel against the others, by bitmaps of channels."""
    return intersecting(channels(spark, sf_dir), "id", ("a", "g", "si", "t", "m"))


@query(f"WITH {CHANNELS_SQL} SELECT id, len(a) > 0 OR len(m) > 0 OR len(r) > 0 AS multi FROM tc")
def has_multi_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels(spark, sf_dir).select("id", reduce(lambda x, y: x | y, [F.size(c) > 0 for c in ("a", "m", "r")]).alias("multi"))


@query(f"WITH {BOOKINGS_SQL} SELECT bk_id FROM query WHERE amount % 3 = 0 OR (list_has_any(g, ['O']) AND list_has_any(a, ['1', '2']))")
def filter_relevant_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with an allocation, or that meet the query."""
    b = bookings(spark, sf_dir).withColumn("allocated", F.when(F.col("amount") % 3 == 0, F.col("amount")).otherwise(F.lit(0)))
    asked = {"g": F.array(F.lit("O")), "a": F.array(F.lit("1"), F.lit("2"))}
    return b.where((F.col("allocated") != 0) | T.channels_intersect({c: F.col(c) for c in asked}, asked, list(asked))).select("bk_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL AND NOT (o_orderstatus = 'F')")
def valid_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.booking import valid

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bk_id"), F.col("o_orderdate").alias("days"), F.col("o_orderpriority").alias("query"), F.col("o_totalprice").alias("amount"), (F.col("o_orderstatus") == "F").alias("del"))
    return valid(o).select(F.col("bk_id").alias("o_orderkey"))


@query(f"WITH {FACT_SQL}, {_KEYS} SELECT uckey FROM k WHERE uckey LIKE '%slot4%'")
def filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir).where(F.col("uckey").contains("slot4"))
