"""Section 2.11, inventory and bookings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import amounts as M
from tidemark.operators import booking as B
from tidemark.operators import inventory as I
from tidemark.operators.targeting import match_channels
from tidemark.plans.filters import ATTRIBUTES, USERS_SQL, users
from tidemark.plans.inputs import BOOKINGS_SQL, CHANNELS_SQL, INVENTORY_SQL, LOGS_SQL, MATCH_SQL, TBR_SQL, behaviour, bookings, channels, inventory, logs
from tidemark.plans.registry import query
from tidemark.sources.scratch import written

_SUM = "h0 + h1 + h2 + h3"
_KEYS = [*ATTRIBUTES, "hour"]
# inventory rows by the bookings that they fit
MATCHED_SQL = f"""
{INVENTORY_SQL}, {BOOKINGS_SQL},
fits AS (SELECT inv.*, {_SUM} AS n, bk_id
FROM inv JOIN query q ON list_contains(q.g, inv.g) AND list_contains(q.a, inv.a))"""
_SIGNED = f"""
{MATCHED_SQL},
sig AS (SELECT day, m, si, t, g, a, r, hour, n, array_to_string(list_sort(list(bk_id)), '|') AS ands
FROM fits GROUP BY ALL),
bb AS (SELECT day, ands, CAST(sum(n) AS BIGINT) AS amount
FROM sig GROUP BY ALL HAVING sum(n) > 0)"""


def matched(spark: SparkSession, sf_dir: str, inv: DataFrame | None = None) -> DataFrame:
    """inv: the inventory, here and below, if the query has it already."""
    inv = (inv or inventory(spark, sf_dir)).withColumn("n", F.expr(_SUM))
    return match_channels(bookings(spark, sf_dir).select("bk_id", "g", "a"), inv, ["g", "a"]).select(*_KEYS, "day", "n", "bk_id")


def buckets(spark: SparkSession, sf_dir: str, inv: DataFrame | None = None) -> DataFrame:
    return B.booking_buckets(matched(spark, sf_dir, inv), _KEYS, amount="n").withColumnRenamed("n", "amount")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bookings(spark, sf_dir)
    return b.select("bk_id", F.expr("substring(bk_id, 2)").alias("rank"), (F.col("amount") / F.size("days")).alias("per_day"), "days")


@query(f"WITH {_SIGNED} SELECT * FROM bb")
def booking_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets(spark, sf_dir).withColumn("ands", F.array_join("ands", "|"))


_TBR = f"""{_SIGNED}, {TBR_SQL},
people AS (
  SELECT k, list(bk_id) AS fits, list(bk_id) FILTER (list_contains(string_split(ai, '-'), 'ai' || (CAST(substr(bk_id, 2, 1) AS INT) % 3))) AS has, any_value(n) AS n
  FROM (SELECT *, row_number() OVER () AS k FROM tbr) tbr JOIN query q ON list_contains(q.g, tbr.g) AND list_contains(q.a, tbr.a) GROUP BY k),
ex AS (SELECT day, string_split(ands, '|') AS s, CAST(amount AS BIGINT) AS n FROM bb),
held AS (SELECT x.day, x.s, y.s AS big, y.n FROM ex x JOIN ex y ON x.day = y.day AND list_has_all(y.s, x.s)),
whole AS (SELECT day, s, sum(n) AS p FROM held GROUP BY ALL),
more AS (SELECT day, s, other, sum(n) AS q, list_sort(list_append(s, other)) AS wider FROM (SELECT day, s, n, unnest(list_filter(big, lambda b: NOT list_contains(s, b))) AS other FROM held) GROUP BY day, s, other),
asked AS (SELECT s FROM ex UNION SELECT wider FROM more),
counted AS (
  SELECT s, CAST(coalesce(sum(CASE WHEN list_has_all(coalesce(has, CAST([] AS VARCHAR[])), s) THEN n ELSE 0 END), 0) AS DOUBLE) AS x, CAST(coalesce(sum(n), 0) AS DOUBLE) AS y
  FROM asked LEFT JOIN people ON list_has_all(fits, s) GROUP BY 1),
shares AS (SELECT s, CASE WHEN y = 0 THEN 0 WHEN abs(x - y) <= 0.001 THEN 1 WHEN x = 0 THEN 0 ELSE x / y END AS t FROM counted),
means AS (SELECT day, more.s, sum(q * t) / sum(q) AS mean FROM more JOIN shares ON shares.s = wider GROUP BY ALL),
cut AS (
  SELECT ex.day, ex.s, CASE WHEN t > 0 THEN CAST(trunc(p * t - (p - n) * coalesce(mean, 0)) AS BIGINT) ELSE 0 END AS amount
  FROM ex JOIN whole ON whole.day = ex.day AND whole.s = ex.s JOIN shares ON shares.s = ex.s LEFT JOIN means ON means.day = ex.day AND means.s = ex.s)"""


@query(f"WITH {_TBR} SELECT day, array_to_string(s, '|') AS ands, amount FROM cut WHERE amount > 0")
def booking_buckets_tbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of people who also have the bookings' behaviours."""
    b = bookings(spark, sf_dir).select("bk_id", "g", "a", F.concat(F.lit("ai"), F.substring("bk_id", 2, 1).cast("int") % 3).alias("want"))
    t = behaviour(spark, sf_dir)
    j = match_channels(b, t.select("g", "a", "ai", "n", F.struct(*t.columns).alias("who")), ["g", "a"])
    has = F.when(F.array_contains(F.split("ai", "-"), F.col("want")), F.col("bk_id"))
    people = j.groupBy("who").agg(F.collect_set("bk_id").alias("fits"), F.collect_set(has).alias("has"), F.first("n").alias("n"))
    cut = B.booking_buckets(matched(spark, sf_dir), _KEYS, amount="n", mode="tbr", people=people.drop("who"))
    return cut.select("day", F.array_join("ands", "|").alias("ands"), F.col("n").alias("amount"))


# Day by day, bookings in order of rank take an equal share of what their buckets have left; one step for each booking
_HWM = f"""{_SIGNED},
todo AS (
  SELECT day, bk_id, per_day, row_number() OVER (PARTITION BY day ORDER BY substr(bk_id, 2), bk_id) AS k
  FROM (SELECT bk_id, amount / CAST(len(days) AS DOUBLE) AS per_day, unnest(days) AS day FROM bookings)),
hwm AS (
  SELECT CAST(0 AS BIGINT) AS k, day, ands, amount, CAST(amount AS DOUBLE) AS remains, CAST(NULL AS VARCHAR) AS bk_id, CAST(0 AS DOUBLE) AS got FROM bb
  UNION ALL
  SELECT k + 1, day, ands, amount, remains - g, bk, g
  FROM (SELECT *, CASE WHEN hit AND pool > 0 THEN floor(remains * least(per_day / pool, 1.0) + 0.5) ELSE 0 END AS g
        FROM (SELECT h.k, h.day, h.ands, h.amount, h.remains, t.bk_id AS bk, t.per_day, list_contains(string_split(h.ands, '|'), t.bk_id) AS hit,
                     sum(CASE WHEN list_contains(string_split(h.ands, '|'), t.bk_id) THEN h.remains ELSE 0 END) OVER (PARTITION BY h.day) AS pool
              FROM hwm h JOIN todo t ON t.day = h.day AND t.k = h.k + 1))),
alloc AS (SELECT day, ands, amount, bk_id, CAST(got AS BIGINT) AS allocated FROM hwm WHERE bk_id IS NOT NULL AND list_contains(string_split(ands, '|'), bk_id))"""
_KEYED = """keyed AS (SELECT day, ands, concat_ws(',', m, si, t, g, a, r, hour) AS key, CAST(n AS BIGINT) AS n FROM sig WHERE n > 0),
shared AS (SELECT *, CAST(sum(n) OVER (PARTITION BY day, ands ORDER BY key) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY day, ands) AS BIGINT) AS total FROM keyed),
served AS (
  SELECT s.day, s.ands, key, bk_id, CAST(floor(allocated * upto / total) - floor(allocated * (upto - n) / total) AS BIGINT) AS allocated
  FROM shared s JOIN alloc x ON x.day = s.day AND x.ands = s.ands WHERE allocated > 0)"""


@query(f"WITH RECURSIVE {_HWM} SELECT * FROM alloc")
def hwm_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hwm_allocate(buckets(spark, sf_dir), demand(spark, sf_dir))


@query(f"WITH RECURSIVE {_HWM}, {_KEYED} SELECT * FROM served")
def hwm_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bucket's allocations shared out over its keys."""
    inv = inventory(spark, sf_dir)
    allocated = B.hwm_allocate(buckets(spark, sf_dir, inv), demand(spark, sf_dir))
    return B.hwm_resources(signed_keys(spark, sf_dir, inv), allocated)


def signed_keys(spark: SparkSession, sf_dir: str, inv: DataFrame | None = None) -> DataFrame:
    """day, ands (joined), key, n: what a bucket is made of."""
    m = matched(spark, sf_dir, inv).groupBy("day", *_KEYS).agg(F.array_join(F.sort_array(F.collect_set("bk_id")), "|").alias("ands"), F.first("n").alias("n"))
    return m.where("n > 0").select("day", "ands", F.concat_ws(",", *_KEYS).alias("key"), "n")


@query(
    f"WITH RECURSIVE {_HWM}, {_KEYED}, per AS (SELECT day, key, bk_id, sum(allocated) AS n FROM served GROUP BY ALL HAVING sum(allocated) > 0)"
    " SELECT day, key, string_agg(bk_id || '=' || n, ',' ORDER BY bk_id) AS plan FROM per GROUP BY ALL"
)
def allocation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each key serves each booking on a day: allocation maps merged key by key."""
    inv = inventory(spark, sf_dir)
    per = B.hwm_resources(signed_keys(spark, sf_dir, inv), B.hwm_allocate(buckets(spark, sf_dir, inv), demand(spark, sf_dir)))
    sums = per.groupBy("day", "key", "bk_id").agg(F.sum("allocated").alias("n")).where("n > 0")
    return sums.groupBy("day", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bk_id", "n"))), lambda s: F.concat_ws("=", s["bk_id"], s["n"].cast("string"))), ",").alias("plan"))


_T = f"""
{TBR_SQL}, {BOOKINGS_SQL},
t AS (SELECT bk_id, CAST(sum(CASE WHEN list_contains(string_split(ai, '-'), 'ai' || (CAST(substr(bk_id, 2, 1) AS INT) % 3)) THEN n ELSE 0 END) AS DOUBLE) AS x, CAST(sum(n) AS DOUBLE) AS y
FROM tbr JOIN query q ON list_contains(q.g, tbr.g) AND list_contains(q.a, tbr.a)
GROUP BY 1),
tr AS (SELECT bk_id, CASE WHEN abs(x - y) <= 0.001 THEN 1 WHEN x = 0 THEN 0 ELSE x / y END AS tbr
FROM t)"""


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bk_id, tbr: the share of the booking's people who also have its behaviour."""
    b = bookings(spark, sf_dir).select("bk_id", "g", "a", F.concat(F.lit("ai"), F.substring("bk_id", 2, 1).cast("int") % 3).alias("want"))
    j = match_channels(b, behaviour(spark, sf_dir), ["g", "a"])
    hit = F.when(F.array_contains(F.split("ai", "-"), F.col("want")), F.col("n")).otherwise(0)
    return j.groupBy("bk_id").agg(F.sum(hit).cast("double").alias("x"), F.sum("n").cast("double").alias("y")).select("bk_id", M.behaviour_ratio(F.col("x"), F.col("y")).alias("tbr"))


@query(f"WITH {_T} SELECT bk_id, round(tbr, 6) AS tbr FROM tr")
def tbr_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios(spark, sf_dir).select("bk_id", F.round("tbr", 6).alias("tbr"))


# For each booking: the bookings of its status with a priority one or two further on are subtracted
_MINUS = f"""
{_T}, {INVENTORY_SQL},
pn AS (SELECT bk_id, CAST(sum({_SUM}) AS DOUBLE) AS p
FROM inv JOIN query q ON list_contains(q.g, inv.g) AND list_contains(q.a, inv.a)
GROUP BY 1),
mm AS (SELECT x.bk_id, y.bk_id AS minus FROM bookings x
JOIN bookings y ON x.g = y.g AND CAST(y.p AS INT) - CAST(x.p AS INT) IN (1, 2)),
av AS (SELECT mm.bk_id, sum(tbr * p) / sum(p) AS avg_tbr
FROM mm JOIN tr ON tr.bk_id = minus JOIN pn ON pn.bk_id = minus
GROUP BY 1)"""


def minus_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bk_id and what is subtracted from it: minus, with its lists g2, a2. A few bookings against each other."""
    b = bookings(spark, sf_dir).select("bk_id", "g", "a")
    place = lambda c: F.substring(c, 2, 1).cast("int")
    o = b.select(F.col("bk_id").alias("minus"), F.col("g").alias("g2"), F.col("a").alias("a2"))
    return b.select("bk_id", "g").join(o, (F.col("g") == F.col("g2")) & (place("minus") - place("bk_id")).isin(1, 2)).select("bk_id", "minus", "g2", "a2")


def average_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = matched(spark, sf_dir).groupBy(F.col("bk_id").alias("minus")).agg(F.sum("n").alias("p"))
    j = minus_bookings(spark, sf_dir).join(p, "minus").join(ratios(spark, sf_dir).withColumnRenamed("bk_id", "minus"), "minus")
    return j.groupBy("bk_id").agg((F.sum(F.col("tbr") * F.col("p")) / F.sum("p")).alias("avg_tbr"))


@query(f"WITH {_MINUS} SELECT bk_id, round(avg_tbr, 6) AS avg_tbr FROM av")
def avg_tbr_for_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_minus(spark, sf_dir).select("bk_id", F.round("avg_tbr", 6).alias("avg_tbr"))


_Q = "(g IN ('O', 'F') AND a IN ('3', '4'))"
_PARTS = f"""
{_MINUS},
fit AS (SELECT q.bk_id, inv.g, inv.a, CAST({_SUM} AS DOUBLE) AS n,
  EXISTS (SELECT 1 FROM mm JOIN query z ON z.bk_id = mm.minus WHERE mm.bk_id = q.bk_id AND list_contains(z.g, inv.g) AND list_contains(z.a,
  inv.a)) AS minus
FROM inv JOIN query q ON list_contains(q.g, inv.g) AND list_contains(q.a, inv.a)),
parts AS (SELECT bk_id, sum(n) AS p, sum(CASE WHEN minus OR {_Q} THEN n ELSE 0 END) AS with_q,
  sum(CASE WHEN minus OR NOT {_Q} THEN n ELSE 0 END) AS with_not_q, sum(CASE WHEN NOT minus AND {_Q} THEN n ELSE 0 END) AS only_q
FROM fit GROUP BY 1)"""


def bucket_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each booking's bucket: its inventory p, and how much of it the subtracted bookings or the query take."""
    m = minus_bookings(spark, sf_dir).groupBy("bk_id").agg(F.collect_list(F.struct("g2", "a2")).alias("others"))
    b = bookings(spark, sf_dir).select("bk_id", "g", "a").join(m, "bk_id", "left")
    j = match_channels(b, inventory(spark, sf_dir).withColumn("n", F.expr(_SUM).cast("double")), ["g", "a"])
    minus = F.coalesce(F.exists("others", lambda o: F.array_contains(o["g2"], F.col("g")) & F.array_contains(o["a2"], F.col("a"))), F.lit(False))
    q = F.col("g").isin("O", "F") & F.col("a").isin("3", "4")
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0.0))
    parts = j.groupBy("bk_id").agg(F.sum("n").alias("p"), part(minus | q).alias("with_q"), part(minus | ~q).alias("with_not_q"), part(~minus & q).alias("only_q"))
    return parts.join(ratios(spark, sf_dir), "bk_id").join(average_minus(spark, sf_dir), "bk_id", "left").withColumn("avg_tbr", F.coalesce("avg_tbr", F.lit(1.0)))


@query(f"""
WITH {_PARTS} SELECT parts.bk_id, round(greatest(p * tbr - greatest(with_q * coalesce(avg_tbr, 1), 0), 0), 4) AS n
FROM parts JOIN tr ON tr.bk_id = parts.bk_id
LEFT JOIN av ON av.bk_id = parts.bk_id""")
def bucket_minus_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bucket keeps outside the query."""
    n = F.col("p") * F.col("tbr") - F.greatest(F.col("with_q") * F.col("avg_tbr"), F.lit(0.0))
    return bucket_parts(spark, sf_dir).select("bk_id", F.round(F.greatest(n, F.lit(0.0)), 4).alias("n"))


@query(f"""
WITH {_PARTS} SELECT parts.bk_id, round(greatest(p * tbr - with_not_q * coalesce(avg_tbr, 1) - only_q * tbr * 0.5, 0), 4) AS n
FROM parts JOIN tr ON tr.bk_id = parts.bk_id
LEFT JOIN av ON av.bk_id = parts.bk_id""")
def bucket_cross_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bucket and the query share; half of the bucket's people are taken to lack the query's behaviour."""
    n = F.col("p") * F.col("tbr") - F.col("with_not_q") * F.col("avg_tbr") - F.col("only_q") * F.col("tbr") * 0.5
    return bucket_parts(spark, sf_dir).select("bk_id", F.round(F.greatest(n, F.lit(0.0)), 4).alias("n"))


#: The days asked for, both included, and the most days of one request; a longer or empty one has no answer.
FIRST_DAY, LAST_DAY, MOST_DAYS = "1996", "1999", 100
_AV = f"""{_HWM}, {CHANNELS_SQL}, {TBR_SQL},
d AS (SELECT tc.id, day, {", ".join(f"CAST(sum(h{i}) AS DOUBLE) AS h{i}" for i in range(4))} FROM tc JOIN inv ON {MATCH_SQL} WHERE day BETWEEN '{FIRST_DAY}' AND '{LAST_DAY}' GROUP BY ALL),
inside AS (SELECT tc.id, inv.day, inv.ands, sum(n) AS inside FROM tc JOIN sig inv ON {MATCH_SQL} WHERE n > 0 AND inv.day BETWEEN '{FIRST_DAY}' AND '{LAST_DAY}' GROUP BY ALL),
given AS (SELECT day, ands, amount, sum(allocated) AS allocated FROM alloc GROUP BY ALL),
booked AS (
  SELECT id, i.day, CAST(sum(greatest(g.allocated - (g.amount - i.inside), 0)) AS BIGINT) AS booked
  FROM inside i JOIN given g ON g.day = i.day AND g.ands = i.ands GROUP BY ALL),
people AS (
  SELECT tc.id, CAST(sum(CASE WHEN list_contains(string_split(ai, '-'), 'ai' || (id % 3)) THEN n ELSE 0 END) AS DOUBLE) AS x, CAST(sum(n) AS DOUBLE) AS y
  FROM tc JOIN tbr ON (len(tc.g) = 0 OR list_contains(tc.g, tbr.g)) AND (len(tc.a) = 0 OR list_contains(tc.a, tbr.a)) GROUP BY 1),
share AS (SELECT id, CASE WHEN abs(x - y) <= 0.001 THEN 1 WHEN x = 0 THEN 0 ELSE x / y END AS ratio FROM people)"""


def in_days(rows: DataFrame, first: str, last: str) -> DataFrame:
    """rows of the days from first to last, none if that is more than MOST_DAYS (of the rows') days."""
    asked = rows.where(F.col("day").between(first, last))
    few = asked.agg(F.countDistinct("day").between(1, MOST_DAYS).alias("few"))  # one row
    return asked.join(F.broadcast(few.where("few")), how="cross").drop("few")


def by_day(spark: SparkSession, sf_dir: str, first: str = FIRST_DAY, last: str = LAST_DAY, inv: DataFrame | None = None) -> DataFrame:
    return I.hourly_sums(match_channels(channels(spark, sf_dir), in_days(inv or inventory(spark, sf_dir), first, last), ATTRIBUTES), ["id", "day"])


def booked(spark: SparkSession, sf_dir: str, first: str = FIRST_DAY, last: str = LAST_DAY, inv: DataFrame | None = None) -> DataFrame:
    """id, day, booked: what the bookings' allocations take of each channel on each day."""
    whole = written(matched(spark, sf_dir, inv), "matched")
    asked = in_days(whole, first, last)
    of_keys = asked.groupBy("day", *_KEYS).agg(F.array_join(F.sort_array(F.collect_set("bk_id")), "|").alias("ands"), F.first("n").alias("n")).where("n > 0")
    fitting = match_channels(channels(spark, sf_dir), of_keys, ATTRIBUTES).groupBy("id", "day", "ands").agg(F.sum("n").alias("inside"))
    cut = B.booking_buckets(whole, _KEYS, amount="n").withColumnRenamed("n", "amount")
    given = B.hwm_allocate(cut, demand(spark, sf_dir)).groupBy("day", "ands", "amount").agg(F.sum("allocated").alias("allocated"))
    return I.booked_by_channel(fitting, given)


def channel_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ratio: the share of the channel's people who also have its behaviour."""
    wanted = channels(spark, sf_dir).select("id", "g", "a", F.concat(F.lit("ai"), F.col("id") % 3).alias("want"))
    j = match_channels(wanted, behaviour(spark, sf_dir), ["g", "a"])
    hit = F.when(F.array_contains(F.split("ai", "-"), F.col("want")), F.col("n")).otherwise(0)
    return j.groupBy("id").agg(F.sum(hit).cast("double").alias("x"), F.sum("n").cast("double").alias("y")).select("id", M.behaviour_ratio(F.col("x"), F.col("y")).alias("ratio"))


_UPTO = " + ".join(f"CASE WHEN d.id % 4 >= {i} THEN h{i} ELSE 0 END" for i in range(4))


@query(
    f"WITH RECURSIVE {_AV}, n AS (SELECT id, sum({_UPTO}) AS n FROM d GROUP BY 1), b AS (SELECT id, sum(booked) AS b FROM booked GROUP BY 1)"
    " SELECT n.id, round(greatest(n * coalesce(ratio, 1) - coalesce(b, 0), 0), 4) AS available FROM n LEFT JOIN share ON share.id = n.id LEFT JOIN b ON b.id = n.id"
)
def available_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel over its days: cumulative by its price category, times its behaviour ratio, less what is booked."""
    n = M.up_to_category([F.col(h) for h in M.H], F.col("id") % 4)
    inv = inventory(spark, sf_dir)
    sums = by_day(spark, sf_dir, inv=inv).groupBy("id").agg(F.sum(n).alias("n"))
    taken = booked(spark, sf_dir, inv=inv).groupBy("id").agg(F.sum("booked").alias("booked"))
    joined = sums.join(channel_ratios(spark, sf_dir), "id", "left").join(taken, "id", "left")
    left = F.col("n") * F.coalesce("ratio", F.lit(1.0)) - F.coalesce("booked", F.lit(0))
    return joined.select("id", F.round(F.greatest(left, F.lit(0.0)), 4).alias("available"))


_BEFORE = ["", " - h0", " - h0 - h1", " - h0 - h1 - h2"]


@query(
    f"WITH RECURSIVE {_AV}, j AS (SELECT d.*, coalesce(booked, 0) AS b FROM d LEFT JOIN booked ON booked.id = d.id AND booked.day = d.day) SELECT id, day, "
    + ", ".join(f"round(h{i} - greatest(least(h{i}, b{before}), 0), 4) AS h{i}" for i, before in enumerate(_BEFORE))
    + " FROM j"
)
def daily_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bookings leave of each channel's day, taken from the cheapest category first."""
    inv = inventory(spark, sf_dir)
    joined = by_day(spark, sf_dir, inv=inv).join(booked(spark, sf_dir, inv=inv), ["id", "day"], "left")
    left = M.after_booked([F.col(h) for h in M.H], F.coalesce("booked", F.lit(0)).cast("double"))
    return joined.select("id", "day", *[F.round(c, 4).alias(h) for c, h in zip(left, M.H)])


@query(f"""
WITH {INVENTORY_SQL}, {CHANNELS_SQL}, ratio(r, ratio) AS (VALUES ('0', 0.5), ('1', 0.5), ('2', 0.25)) SELECT tc.id, hour,
  round(CAST(sum(({_SUM}) * coalesce(ratio, 1.0)) AS DOUBLE), 4) AS n
FROM tc JOIN inv ON {MATCH_SQL} LEFT JOIN ratio ON ratio.r = inv.r
GROUP BY ALL""")
def hourly_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = spark.createDataFrame([("0", 0.5), ("1", 0.5), ("2", 0.25)], "r string, ratio double")
    inv = inventory(spark, sf_dir).join(F.broadcast(ratio), "r", "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    sums = I.hourly_sums(match_channels(channels(spark, sf_dir), inv, ATTRIBUTES), ["id", "hour"], F.col("ratio"))
    return sums.select("id", "hour", F.round(M.total_of([F.col(h) for h in M.H]), 4).alias("n"))


_LINE = """
list_sum(list_transform(range(len(y)), lambda i: (i - (len(y) - 1) / 2.0) * y[i + 1])) / list_sum(list_transform(range(len(y)),
  lambda i: (i - (len(y) - 1) / 2.0) * (i - (len(y) - 1) / 2.0)))"""


@query(f"""WITH RECURSIVE {USERS_SQL},
u AS (SELECT aid, CAST(day AS DATE) AS day, unnest(kws) AS keyword FROM users),
w AS (SELECT keyword, aid, unnest([day - 2, day - 1, day]) AS first FROM u),
c AS (SELECT keyword, first, CAST(count(DISTINCT aid) AS DOUBLE) AS n FROM w GROUP BY ALL),
e AS (
  SELECT keyword, 0 AS step, list(n ORDER BY first) AS y FROM c GROUP BY 1
  UNION ALL
  SELECT keyword, step + 1, list_append(y, (2 * list_avg(y) + (CASE WHEN len(y) < 2 THEN 0 ELSE {_LINE} END) * (len(y) + 1) / 2.0) / 2) FROM e WHERE step < 5)
SELECT keyword, round(y[len(y)], 4) AS estimate FROM e WHERE step = 5""")
def user_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of each keyword in sliding windows of three days, carried on by a line and a mean five times."""
    u = users(spark, sf_dir).select("aid", F.to_date("day").alias("day"), F.explode("kws").alias("keyword"))
    in_windows = u.select("keyword", "aid", F.explode(F.sequence(F.date_sub("day", 2), F.col("day"))).alias("first"))
    counts = in_windows.groupBy("keyword", "first").agg(F.countDistinct("aid").alias("n")).withColumn("steps", F.lit(5))
    return I.recursive_estimate(counts, "keyword", "first", "n", "steps").withColumn("estimate", F.round("estimate", 4))


@query(f"""WITH RECURSIVE {_SIGNED},
todo AS (
  SELECT day, bk_id, wanted, row_number() OVER (PARTITION BY day ORDER BY substr(bk_id, 2), bk_id) AS k
  FROM (SELECT bk_id, amount // 10 AS wanted, unnest(days) AS day FROM bookings)),
served AS (
  SELECT CAST(0 AS BIGINT) AS k, day, ands, amount AS remains, CAST(NULL AS VARCHAR) AS request, CAST(0 AS BIGINT) AS booked FROM bb
  UNION ALL
  SELECT k + 1, day, ands, remains - got, bk, got
  FROM (SELECT *, CASE WHEN hit THEN CAST(greatest(least(remains, wanted - coalesce(before, 0)), 0) AS BIGINT) ELSE 0 END AS got
        FROM (SELECT s.k, s.day, s.ands, s.remains, t.bk_id AS bk, t.wanted, list_contains(string_split(s.ands, '|'), t.bk_id) AS hit,
                     sum(CASE WHEN list_contains(string_split(s.ands, '|'), t.bk_id) THEN s.remains ELSE 0 END)
                       OVER (PARTITION BY s.day ORDER BY len(string_split(s.ands, '|')), s.ands ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM served s JOIN todo t ON t.day = s.day AND t.k = s.k + 1)))
SELECT day, ands, request, booked FROM served WHERE booked > 0""")
def allocate_booking_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order against the buckets of each day: a request takes what it still wants from each, cheapest first."""
    requests = bookings(spark, sf_dir).select(F.col("bk_id").alias("request"), F.expr("substring(bk_id, 2)").alias("rank"), (F.col("amount") / 10).cast("long").alias("wanted"), F.explode("days").alias("day"))
    return B.allocate_batch(buckets(spark, sf_dir), requests)


@query(
    f"WITH RECURSIVE {_HWM} SELECT b.bk_id, b.bk_id IN ('b1F', 'b3O') AS del, CAST(coalesce(sum(CASE WHEN b.bk_id IN ('b1F', 'b3O') THEN 0 ELSE allocated END), 0) AS BIGINT) AS allocated"
    " FROM bookings b LEFT JOIN alloc ON alloc.bk_id = b.bk_id GROUP BY 1"
)
def cancel_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bookings are marked deleted and their allocation in every bucket becomes 0."""
    gone = F.col("bk_id").isin("b1F", "b3O")
    held = B.hwm_allocate(buckets(spark, sf_dir), demand(spark, sf_dir)).withColumn("allocated", F.when(gone, F.lit(0)).otherwise(F.col("allocated")))
    sums = held.groupBy("bk_id").agg(F.sum("allocated").alias("n"))
    return bookings(spark, sf_dir).select("bk_id").join(sums, "bk_id", "left").select("bk_id", gone.alias("del"), F.coalesce("n", F.lit(0)).cast("long").alias("allocated"))


@query(f"""
WITH {BOOKINGS_SQL},
e AS (SELECT bk_id, amount, unnest(days) AS day
FROM bookings) SELECT day, string_agg(bk_id, ','
ORDER BY bk_id) AS ids, CAST(sum(amount) AS BIGINT) AS amount
FROM e WHERE bk_id <> 'b1F' GROUP BY 1""")
def bookings_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = bookings(spark, sf_dir).where("bk_id <> 'b1F'").select("bk_id", "amount", F.explode("days").alias("day"))
    return live.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list("bk_id")), ",").alias("ids"), F.sum("amount").alias("amount"))


_CURVE = f"""
{LOGS_SQL},
s AS (SELECT aid, sum(is_click) / CAST(count(*) AS DOUBLE) AS v, count(*) AS n
FROM logs WHERE keyword = 'kw3' GROUP BY 1),
b AS (SELECT CAST(trunc(v * 100) AS INT) // 10 AS bucket, CAST(sum(n) AS BIGINT) AS n
FROM s GROUP BY 1)"""


@query(f"WITH {_CURVE} SELECT CAST(bucket AS INT) AS bucket, n, CAST(sum(n) OVER (ORDER BY bucket DESC) AS BIGINT) AS reached FROM b")
def performance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory from the best click probability down. The running sum goes over one row a bucket, eleven at most."""
    s = logs(spark, sf_dir).where("keyword = 'kw3'").groupBy("aid").agg((F.sum("is_click") / F.count("*")).alias("v"), F.count("*").alias("n"))
    b = s.groupBy(F.expr("cast(v * 100 as int) div 10").cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    return b.select("bucket", "n", F.sum("n").over(w).alias("reached"))


@query(f"WITH {BOOKINGS_SQL}, e AS (SELECT DISTINCT unnest(days) AS day FROM bookings) SELECT day FROM e WHERE day >= '1997'")
def booking_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookings(spark, sf_dir).select(F.explode("days").alias("day")).where("day >= '1997'").distinct()


@query(f"""
WITH {_SIGNED} SELECT day, ands, amount, day >= '2000' AS del
FROM bb UNION ALL SELECT day, ands, amount * 2, false
FROM bb WHERE day >= '2000'""")
def replace_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of some days are marked deleted and new ones added."""
    bb = buckets(spark, sf_dir).withColumn("ands", F.array_join("ands", "|"))
    new = bb.where("day >= '2000'").withColumn("amount", F.col("amount") * 2)
    return B.replace_buckets(bb, new)
