"""Operators on small rows with known results, and properties."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import amounts as M
from tidemark.functions import keys as K
from tidemark.functions import series as Z
from tidemark.operators import booking as B
from tidemark.operators import logs as L
from tidemark.operators import series as S
from tidemark.operators.graph import connected_components
from tidemark.operators.indexing import bucketed_row_index, dense_index
from tidemark.operators.similarity import balanced_clusters, top_similar


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_buckets_of_known_keys(spark):
    keys = ["banner,b8nyhficur,4G,,,CPM,80", "banner,d3lxq4l6rn,WIFI,g_m,3,CPM,28", "banner,k5hz58vpst,4G,,,CPM,76"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", K.sha256_bucket(F.col("k"), 10).alias("b"))
    assert {r["k"]: r["b"] for r in df.collect()} == dict(zip(keys, (9, 3, 0)))


def test_key_rewriting(spark):
    k = F.lit("banner,b8nyhficur,4G,,,CPM,1,249")
    assert one(spark, K.drop_part(k, 6)) == "banner,b8nyhficur,4G,,,CPM,249"
    assert one(spark, K.replace_part(k, 7, F.lit("80"))) == "banner,b8nyhficur,4G,,,CPM,1,80"
    assert one(spark, K.blank_part(k, 6)) == "banner,b8nyhficur,4G,,,CPM,,249"
    assert one(spark, K.part(k, 20)) == ""


def test_series_scalars(spark):
    v = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in ([1, 2, 1, 2, 1], [0, 1, 2], [0, 0, 0])])
    assert one(spark, Z.vector_sum(v)) == [1, 3, 3, 2, 1]
    ts = F.array(F.lit(None).cast("long"), F.lit(21).cast("long"))
    assert one(spark, Z.total(ts)) == 21
    assert one(spark, Z.popularity(ts)) == 10.5
    assert one(spark, Z.first_active(ts)) == 1 and one(spark, Z.last_active(ts)) == 1
    empty = F.array().cast("array<long>")
    assert one(spark, Z.popularity(empty)) == 0 and one(spark, Z.median(empty)) is None and one(spark, Z.first_active(empty)) == -1
    assert one(spark, Z.pairs_to_map(F.array(F.lit("1:21"), F.lit("3:2"), F.lit("1:5")))) == {"3": "2", "1": "5"}


def test_zscores(spark):
    df = S.zscores(spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double"), ["x"])
    assert df.orderBy("x").first()["x_n"] == pytest.approx(-1.2649110640673518)
    assert S.zscores(spark.createDataFrame([(1.0,)], "x double"), ["x"]).first()["x_n"] == 0


def test_weak_and_sparse_series(spark):
    df = spark.createDataFrame([("a", [None, 21]), ("b", [2, None]), ("c", [None, None])], "uckey string, ts array<long>")
    kept = S.without_weak(df, 5.0, 0.15).collect()
    assert [(r["uckey"], r["imp"], r["p"]) for r in kept] == [("a", 21, 10.5)]
    assert one(spark, S.is_sparse(F.lit(10.5), F.array(F.lit(None).cast("long"), F.lit(21).cast("long")), 0.5, 0.01)) is True


def test_similarity_of_known_vectors(spark):
    rows = [(1, [0.1, 0.8, 0.9]), (2, [0.1, 0.1, 0.1]), (3, [0.1, 0.8, 0.9]), (4, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = {r["a"]: [(n["b"], n["score"]) for n in r["near"]] for r in top_similar(df, 4).collect()}
    assert [b for b, _ in near[1]] == [1, 3, 4, 2]
    scores = dict(near[1])
    assert scores[3] == pytest.approx(math.sqrt(3), abs=1e-3) and scores[4] == pytest.approx(0.8835, abs=1e-3) and scores[2] == pytest.approx(0.6690, abs=1e-3)
    assert dict(near[2])[4] == pytest.approx(1.5084, abs=1e-3)


def test_balanced_clusters(spark):
    sizes = [*range(100, 2000, 100), 2000, 1500]
    rows = [(100_000 * c + i, c) for c, n in enumerate(sizes) for i in range(n)]
    out = balanced_clusters(spark.createDataFrame(rows, "id long, cluster long"), 1000).groupBy("cluster").count().collect()
    assert sum(r["count"] for r in out) == len(rows)
    assert all(r["count"] < 2000 for r in out) and sum(r["count"] < 900 for r in out) <= 1


@pytest.mark.parametrize(
    "buckets, wants, expected",
    [
        ([(["b8"], 3239)], {"b8": 88}, {"b8": 88}),
        ([(["b11", "b12"], 8900)], {"b11": 11, "b12": 12}, {"b11": 11, "b12": 12}),
        ([(["b6", "b7", "b10"], 8900)], {"b6": 66, "b7": 77, "b10": 100}, {"b6": 66, "b7": 77, "b10": 100}),
        ([(["b12", "b13"], 8900)], {"b13": 130000, "b12": 12}, {"b13": 8900}),
        ([(["b16", "b17"], 8900)], {"b16": 4450, "b17": 4450}, {"b16": 4450, "b17": 4450}),
        ([(["b17", "b18"], 8900)], {"b17": 4450, "b18": 4451}, {"b17": 4450, "b18": 4450}),
    ],
)
@pytest.mark.parametrize("scope", ["day", "all_days"])
def test_hwm(spark, buckets, wants, expected, scope):
    bb = spark.createDataFrame([("20180405", a, n) for a, n in buckets], "day string, ands array<string>, amount long")
    demand = spark.createDataFrame([(b, i, float(n), ["20180405"]) for i, (b, n) in enumerate(wants.items())], "bk_id string, rank int, per_day double, days array<string>")
    out = B.hwm_allocate(bb, demand, scope).where("allocated > 0").collect()
    assert {r["bk_id"]: r["allocated"] for r in out} == expected


def test_allocation_keeps_within_amounts(spark, sf):
    from tidemark.plans import inventory as P

    out = B.hwm_allocate(P.buckets(spark, sf), P.demand(spark, sf))
    assert out.groupBy("day", "ands", "amount").agg(F.sum("allocated").alias("n")).where("n > amount").count() == 0
    keys = B.hwm_resources(P.signed_keys(spark, sf), out).groupBy("day", "ands", "bk_id").agg(F.sum("allocated").alias("k"))
    j = out.where("allocated > 0").join(keys, ["day", "ands", "bk_id"], "left")
    assert j.where("not (k <=> allocated)").count() == 0


def test_large_components_are_allocated_by_levels(spark):
    import random

    rng = random.Random(5)
    names = [f"b{i}" for i in range(5)]
    rows = {(d, tuple(sorted(rng.sample(names, rng.randrange(1, 4))))): rng.randrange(50, 900) for d in ("d1", "d2") for _ in range(9)}
    bb = spark.createDataFrame([(d, list(a), n) for (d, a), n in rows.items()], "day string, ands array<string>, amount long")
    demand = spark.createDataFrame([(b, i % 3, 300.0 + 70 * i, ["d1", "d2"]) for i, b in enumerate(names)], "bk_id string, rank int, per_day double, days array<string>")
    for scope in ("day", "all_days"):
        one, many = ({tuple(r) for r in B.hwm_allocate(bb, demand, scope, few).collect()} for few in (10**6, 0))
        assert one == many and sum(r[4] for r in one) > 1000
    requests = spark.createDataFrame([(b, i % 3, 400 + 90 * i, d) for i, b in enumerate(names) for d in ("d1", "d2")], "request string, rank int, wanted long, day string")
    one, many = ({tuple(r) for r in B.allocate_batch(bb, requests, few).collect()} for few in (10**6, 0))
    assert one == many and len(one) > 10


def plain_hwm(buckets, demand):
    """The fold: one booking after another."""
    left, out = dict(buckets), {}
    for b, wants in demand:
        own = [k for k in left if b in k]
        remaining = sum(left[k] for k in own)
        for k in own:
            out[k, b] = int(left[k] * min(wants / remaining, 1.0) + 0.5) if remaining else 0
            left[k] -= out[k, b]
    return out


def test_five_thousand_bookings_in_rounds_of_the_longest_chain(spark):
    import random

    from tidemark.operators.levels import placed_by_level

    rng, n = random.Random(8), 5000
    # neighbours share buckets, so that all bookings are one component; few of them wait for one another
    sets = {tuple(sorted({f"b{i}", f"b{(i + 1) % n}"})) for i in range(n)} | {tuple(sorted({f"b{rng.randrange(n)}" for _ in range(2)})) for _ in range(1000)}
    buckets = {a: rng.randrange(50, 900) for a in sets}
    order = rng.sample(range(n), n)
    demand = [(f"b{b}", rank, float(rng.randrange(1, 900)), ["d"]) for rank, b in enumerate(order)]
    rows = spark.createDataFrame([("d", list(a), x) for a, x in buckets.items()], "day string, ands array<string>, amount long")
    got = B.hwm_allocate(rows, spark.createDataFrame(demand, "bk_id string, rank int, per_day double, days array<string>"), one_task=0)
    want = plain_hwm(buckets, [(b, w) for b, _, w, _ in demand])
    assert {(tuple(r["ands"].split("|")), r["bk_id"]): r["allocated"] for r in got.collect()} == want

    level, last = {}, {}
    for b, *_ in demand:
        own = [a for a in sets if b in a]
        level[b] = 1 + max(last.get(a, 0) for a in own)
        last.update({a: level[b] for a in own})
    held = rows.withColumn("bk_id", F.explode("ands")).join(spark.createDataFrame([r[:2] for r in demand], "bk_id string, rank int"), "bk_id").withColumn("ands", F.array_join("ands", "|"))
    placed, levels = placed_by_level(held, ["day", "ands"], ["day", "bk_id"], ["rank", "bk_id"])
    assert levels == max(level.values()) < 30
    assert {(r["bk_id"], r["level"]) for r in placed.collect()} == set(level.items())


def test_running_sums_and_shares_of_hot_keys(spark):
    import random

    from tidemark.operators.indexing import running_sum
    from tidemark.operators.logs import cumulative_share

    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(5)
    got = {(r["k"], r["i"]): r["s"] for r in running_sum(df, ["k"], ["i"], "n", "s").collect()}
    assert got == {(k, i): sum(n for q, j, n in rows if q == k and j <= i) for k, i, _ in rows}
    got = sorted((r["k"] or "", r["n"], round(r["p"], 9)) for r in cumulative_share(df.select("k", "n"), "k", "n", "p").collect())
    assert got == sorted((k or "", n, round(sum(q == k and m <= n for q, _, m in rows) / sum(q == k for q, _, _ in rows), 9)) for k, _, n in rows)


def fits(lists, values):
    """A null list fits nothing, a null value only empty lists."""
    return all(x is not None and (not x or v in x and v is not None) for x, v in zip(lists, values))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_channels_of_odd_rows(spark, how):
    from tidemark.operators.targeting import match_channels

    channels = [(1, ["x"], []), (2, [], ["p", "q"]), (3, ["x", "x"], [None, "p"]), (4, ["x", "y"], ["p"]), (5, ["none"], []), (6, None, []), (7, [], [None])]
    rows = [("x", "p", 1), ("y", "p", 2), ("z", "z", 3), ("x", None, 4), ("*", "q", 5), ("x", "p", 1), (None, None, 6), ("", "", 7)]
    df = match_channels(spark.createDataFrame(channels, "id int, g array<string>, a array<string>"), spark.createDataFrame(rows, "g string, a string, n int"), ["g", "a"], how)
    want = [(*r, c[0]) for r in rows for c in channels if fits(c[1:], r)]
    want += [(*r, None) for r in rows if how == "left" and not any(fits(c[1:], r) for c in channels)]
    assert sorted(map(repr, (tuple(r) for r in df.select("g", "a", "n", "id").collect()))) == sorted(map(repr, want))
    assert match_channels(df.sparkSession.createDataFrame([], "id int, g array<string>, a array<string>"), spark.createDataFrame(rows, "g string, a string, n int"), ["g", "a"], how).count() == (8 if how == "left" else 0)


def test_fifty_thousand_channels(spark):
    import random

    from tidemark.operators.targeting import match_channels

    rng = random.Random(3)
    pick = lambda n: [f"v{rng.randrange(n)}" for _ in range(rng.randrange(4))]
    channels = [(i, pick(40), pick(9), pick(500)) for i in range(50_000)]
    rows = [(f"v{i % 45}", f"v{i % 10}", f"v{rng.randrange(500)}", i) for i in range(60)]
    df = match_channels(spark.createDataFrame(channels, "id int, g array<string>, a array<string>, r array<string>"), spark.createDataFrame(rows, "g string, a string, r string, n int"), ["g", "a", "r"])
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))
    got = {(r["id"], r["n"]) for r in df.select("id", "n").collect()}
    assert got == {(c[0], r[3]) for c in channels for r in rows if fits(c[1:], r)}
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_channels_that_meet(spark):
    import random

    from tidemark.operators.targeting import intersecting

    rng = random.Random(4)
    pick = lambda n: [f"v{rng.randrange(n)}" for _ in range(rng.randrange(3))]
    channels = [(i, pick(5), pick(9)) for i in range(150)] + [(150, None, [])]
    meet = lambda x, y: all(a is not None and b is not None and (not a or not b or set(a) & set(b)) for a, b in zip(x[1:], y[1:]))
    got = {tuple(r) for r in intersecting(spark.createDataFrame(channels, "id int, g array<string>, a array<string>"), "id", ["g", "a"]).collect()}
    assert got == {(x[0], y[0], bool(meet(x, y))) for x in channels for y in channels if x[0] < y[0]}


def test_exact_search_leaves_blocks_out(spark, monkeypatch):
    import numpy as np

    from tidemark.operators import nearest as N

    monkeypatch.setattr(N, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(9)
    grouped = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 4 + rng.normal(size=(4000, 16)) * 0.3
    grouped[100:140] = grouped[7]  # copies, a tie of all of them
    even = rng.normal(size=(1200, 16))
    for x, skipped in ((grouped, 0.8), (even, 0.0)):
        rows = [(["p", "q"][i % 7 == 0], i, v.tolist(), i % 3 != 1) for i, v in enumerate(x)]
        found = N.nearest(spark.createDataFrame(rows, "g string, id long, v array<double>, asked boolean"), 6, cell_rows=50).collect()
        assert sorted(r["a"] for r in found) == [i for _, i, _, asked in rows if asked]
        own = {g: np.array([i for h, i, *_ in rows if h == g]) for g in "pq"}
        for r in found:
            ids = own[rows[r["a"]][0]]
            d = N.distances(x[r["a"] : r["a"] + 1], x[ids])[0]
            want = ids[np.lexsort((ids, np.round(d, 6)))[:6]]
            assert np.allclose(d[np.searchsorted(ids, r["b"])], np.sort(d)[:6], atol=1e-6) and len(set(r["b"])) == 6
            assert r["a"] >= 100 and r["a"] < 140 or r["b"] == want.tolist()
        compared, pairs = sum(r["seen"] for r in found), sum(len(own[rows[r["a"]][0]]) for r in found)
        assert compared <= (1 - skipped) * pairs
    assert N.nearest(spark.createDataFrame([], "g string, id long, v array<double>, asked boolean"), 3).collect() == []


def test_recall_of_the_coarse_index(spark, sf):
    import numpy as np

    from tidemark.operators.similarity import top_similar_in_cells

    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] * 3 + rng.normal(size=(1500, 16))
    grouped = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for df, n, cells, probes in ((grouped, 10, 16, 3), (spark.read.parquet(f"{sf}/embeddings.parquet"), 5, 16, 12)):
        queries = df.where("vec_id % 7 = 0").select("vec_id")
        exact = {r["a"]: {b["b"] for b in r["near"]} for r in top_similar(df, n, queries=queries).collect()}
        found = {r["a"]: {b["b"] for b in r["near"]} for r in top_similar_in_cells(df, n, cells, probes, queries=queries).collect()}
        assert found.keys() == exact.keys() and sum(len(found[a] & exact[a]) for a in exact) >= 0.9 * sum(map(len, exact.values()))


def test_booked_inventory(spark):
    from tidemark.operators.inventory import booked_by_channel

    fitting = spark.createDataFrame([(1, "d", "a|b", 40), (1, "d", "a", 100), (2, "d", "a|b", 100), (1, "e", "a", 10)], "id int, day string, ands string, inside long")
    given = spark.createDataFrame([("d", "a|b", 100, 70), ("d", "a", 150, 20), ("e", "a", 10, 10)], "day string, ands string, amount long, allocated long")
    # of the first bucket 60 lie outside channel 1 and serve 60 of 70; channel 2 has all of it
    assert {(r["id"], r["day"]): r["booked"] for r in booked_by_channel(fitting, given).collect()} == {(1, "d"): 10, (2, "d"): 70, (1, "e"): 10}


def test_regression(spark):
    rows = [("a", i, y) for i, y in enumerate([1.1, 2.2, 3.3, 4.4, 500.0])] + [("b", i, y) for i, y in enumerate([1.0, 20.0, 300.0, 4000.0, 50000.0])]
    df = spark.createDataFrame(rows, "k string, i int, y double").groupBy("k").agg((F.regr_intercept("y", "i") + 5 * F.regr_slope("y", "i")).alias("n"))
    got = {r["k"]: r["n"] for r in df.collect()}
    assert got["a"] == pytest.approx(402.2, abs=0.1) and got["b"] == pytest.approx(42057.6, abs=0.1)


def test_hampel_finds_a_spike(spark):
    ts = F.array(*[F.lit(x).cast("long") for x in (10, 11, 10, 12, 500, 11, 10, 12, 11, 10)])
    r = one(spark, Z.hampel(ts, 2, 3.0))
    assert r["outliers"] >= 1 and r["ts"][4] < 20


def test_hampel_and_band_against_pandas(spark):
    import pandas as pd

    x = [0, 4, 9, 200, 7, 0, 5, 6, 90, 3, 2, 8]
    s = pd.Series(x, dtype=float)
    roll = lambda y, w: y.rolling(w, center=True).median().bfill().ffill()
    m = roll(s, 4)
    out = ((s - m).abs() >= 1.5 * 1.4826 * roll((s - m).abs(), 4)) & ((s - m).abs() > 0)
    ts = F.array(*[F.lit(v).cast("long") for v in x])
    got = one(spark, Z.hampel(ts, 2, 1.5))
    assert got["outliers"] == int(out.sum()) and got["ts"] == s.where(~out, m).tolist()
    lo, hi = max(s.quantile(0.1), 4.0), s.quantile(0.9)
    want = s.where((s >= lo) & (s <= hi), roll(s, max(len(s) // 2, 4)))
    assert one(spark, Z.denoised_band(ts, 0.1, 0.9)) == pytest.approx(want.tolist())
    assert one(spark, Z.denoised_band(F.array().cast("array<long>"), 0.1, 0.9)) == []


def test_waterfall_and_shares(spark):
    assert [one(spark, c) for c in M.after_booked([F.lit(10), F.lit(5), F.lit(7)], F.lit(12))] == [0, 3, 7]
    assert sum(M.HOUR_PERCENT) == pytest.approx(100, abs=1e-6)
    assert one(spark, M.price_category(F.lit(12.0), F.lit("CPM"))) == 1 and one(spark, M.price_category(F.lit(-1.0), F.lit("CPM"))) == 0 and one(spark, M.price_category(F.lit(1.0), F.lit("NONE"))) == 3


def test_redistribution_keeps_mass(spark, sf):
    from tidemark.plans import analytics, joins

    m = joins.members(spark, sf)
    want = S.index_totals(m).agg(F.sum("total")).first()[0]
    got = analytics.redistribute_predictions(spark, sf).agg(F.sum("value")).first()[0]
    assert got == pytest.approx(float(want), rel=1e-4)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (5, None)] + [(100, i) for i in range(101, 200)] + [(i, i + 1) for i in range(300, 340)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got[3] == 1 and got[8] == 7 and got[9] == 9 and got[150] == 100 and got[340] == 300 and 5 not in got
    assert connected_components(edges.where("u < 0")).count() == 0


def test_indexes(spark):
    df = spark.createDataFrame([(f"k{i % 37:03d}",) for i in range(200)] + [(None,)], "k string")
    got = {r["k"]: r["index"] for r in dense_index(df, "k").collect()}
    assert got == {f"k{i:03d}": i + 1 for i in range(37)}
    rows = bucketed_row_index(df.where("k is not null").distinct(), "k", 4).collect()
    assert sorted(r["row_index"] for r in rows) == list(range(1, 38))


def test_user_windows_match_batch(spark, sf):
    from tidemark.plans.streams import stream_user_days

    e = spark.read.parquet(f"{sf}/events.parquet")
    exact = e.groupBy(F.window("ts", "3 days", "1 day").alias("w"), "event_type").agg(F.countDistinct("user_id").alias("n")).select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("first_day"), "n")
    j = stream_user_days(spark, sf).join(exact, ["event_type", "first_day"]).collect()
    assert j and all(abs(r["users"] - r["n"]) <= max(2, 0.05 * r["n"]) for r in j)


def test_bucketed_tables_are_joined_without_a_shuffle(spark, sf):
    from tidemark.plans.joins import join_bucketed_fact

    plan = join_bucketed_fact(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_distinct_sketches(spark, sf):
    from tidemark.operators import sketches as K
    from tidemark.streaming import windows as W

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("day", F.to_date("ts"))
    batch = K.distinct_sketch(e, ["day", "event_type"], "user_id")
    stream = W.event_stream(spark, f"{sf}/events.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    streamed = W.drained(W.daily_sketches(stream, "ts", "user_id", ["event_type"]), "sketches").select(F.to_date("window_start").alias("day"), "event_type", "register", "rank")
    days = [r["day"] for r in streamed.select("day").distinct().collect()]
    assert len(days) > 5 and sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.where(F.col("day").isin(days)).collect()))
    merged = K.merged_sketch(K.distinct_sketch(e, ["day", "event_type"], "user_id"), ["event_type"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, K.distinct_sketch(e, ["event_type"], "user_id").collect()))
    for n, most in ((1, 0), (50, 0.03), (3000, 0.022), (20_000, 0.022)):  # 20 groups of n values, each twice
        values = spark.range(40 * n).select((F.col("id") % (20 * n)).alias("u")).withColumn("k", F.expr(f"u div {n}"))
        got = [r["n"] for r in K.distinct_estimate(K.distinct_sketch(values, ["k"], "u"), ["k"], "n").collect()]
        assert len(got) == 20 and (sum((x / n - 1) ** 2 for x in got) / 20) ** 0.5 <= most
    assert K.distinct_estimate(K.distinct_sketch(values.limit(0), ["k"], "u"), ["k"], "n").collect() == []


def test_quantile_sketches(spark):
    from tidemark.operators import sketches as K

    values = spark.range(40_000).select((F.col("id") % 30).alias("day"), F.lit("k").alias("k"), F.when(F.col("id") % 7 > 0, F.pow(F.xxhash64("id") % 1000, F.lit(3.0))).alias("x"))
    found = K.merged_quantiles(K.quantile_sketch(values, ["k", "day"], "x"), ["k"], [0.1, 0.5, 0.99]).first()
    x = sorted(r["x"] for r in values.where("x is not null").collect())
    assert found["n"] == len(x)
    for r, q in zip((0.1, 0.5, 0.99), found["quantiles"]):
        assert sum(v < q for v in x) <= (r + 0.02) * len(x) and sum(v <= q for v in x) >= (r - 0.02) * len(x)


def test_folds(spark, monkeypatch):
    import random

    from tidemark.operators import folds

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(3), rng.randrange(5000) if rng.random() < 0.95 else None) for _ in range(2000)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, day int, at long").repartition(7)
    for groups in (10_000, 1):
        monkeypatch.setattr(folds, "GROUPS", groups)
        got = {(r["k"], r["day"]): (r["n"], r["covered"]) for r in folds.folded(df, ["k", "day"], folds.Coverage("at", 4)).collect()}
        want = {}
        for k, day, at in rows:
            n, seen = want.get((k, day), (0, set()))
            want[k, day] = n + 1, seen | (set(range(at, at + 4)) if at is not None else set())
        assert got == {k: (n, len(seen)) for k, (n, seen) in want.items()}
    assert folds.folded(df.limit(0), ["k"], folds.Coverage("at", 4)).collect() == []


def test_table_functions(spark):
    from tidemark.operators.table_functions import register_table_functions

    register_table_functions(spark)
    rows = spark.sql("SELECT n, part, q FROM VALUES (3), (10), (25), (null) AS t(n), LATERAL split_amount(n, 10)").collect()
    assert sorted(map(tuple, rows)) == [(3, "moved", 3), (10, "moved", 10), (25, "kept", 15), (25, "moved", 10)]
    assert sorted(map(tuple, spark.sql("SELECT part, q FROM split_amount(2.5D, 1)").collect())) == [("kept", 1.5), ("moved", 1.0)]
    lines = spark.createDataFrame([("a", 2, 5), ("a", 1, 7), ("b", 1, None), ("a", 3, 4), ("b", 2, 30)], "k string, o int, q int")
    got = spark.sql("SELECT * FROM split_running(TABLE({t}), 10, 'k', 'o', 'q')", t=lines).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "moved", 7.0), ("a", 2, "kept", 2.0), ("a", 2, "moved", 3.0), ("a", 3, "kept", 4.0), ("b", 2, "kept", 20.0), ("b", 2, "moved", 10.0)]


def test_split_running_with_rows_at_one_place(spark):
    """Rows of equal order share their running sum, as in the SQL of udtf_partitioned; null orders come last."""
    import duckdb

    from tidemark.operators.table_functions import register_table_functions
    from tidemark.plans.catalog import ORACLES

    register_table_functions(spark)
    rows = [(1, 5.0, 20), (1, 5.0, 20), (1, 5.0, 15), (2, 1.0, 30), (2, 2.0, 30), (2, 2.0, 30), (2, 3.0, 5), (3, 1.0, 10), (3, 1.0, 10), (3, None, 30), (3, 2.0, None), (4, 1.0, 50), (4, 1.0, 50)]
    lines = spark.createDataFrame([(k, o, q if q is None else float(q)) for k, o, q in rows], "l_orderkey int, l_extendedprice double, l_quantity double")
    got = spark.sql("SELECT * FROM split_running(TABLE({t}), 40, 'l_orderkey', 'l_extendedprice', 'l_quantity')", t=lines).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey INT, l_extendedprice DOUBLE, l_quantity DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?)", rows)
    want = con.execute(ORACLES["udtf_partitioned"]).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert L.auc(df, "y", "s").first()["auc"] == pytest.approx(0.875)
    assert L.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


@pytest.mark.parametrize("name", ["compare_runs", "join_cluster_features", "join_left_anti", "win_cluster_imp", "join_bucketed_fact", "hourly_chart"])
def test_lines_are_joined_once(spark, sf, name):
    """What sums the lines of orders is written once; the plan that reads it several times doesn't join them again."""
    from tidemark.plans.catalog import QUERIES

    assert "lineitem" not in "".join(QUERIES[name](spark, sf).inputFiles())


@pytest.mark.parametrize("name", ["topk_similar_users", "topk_merge", "topk_coarse_index"])
def test_searches_ask_for_every_fiftieth_vector(spark, sf, name):
    from tidemark.plans.catalog import QUERIES

    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    rows = QUERIES[name](spark, sf).select("a", "near").collect()
    assert sorted(r["a"] for r in rows) == sorted(i for i in ids if i % 50 == 0)
    assert {int(b) for r in rows for b in r["near"].split(",")} - {i for i in ids if i % 50 == 0}


@pytest.mark.parametrize("name", ["topk_similar_users", "topk_merge"])
def test_exact_searches_ask_for_every_vector(spark, sf, name):
    from tidemark.plans.catalog import ORACLES, QUERIES

    ids = [r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r["a"] for r in QUERIES[name](spark, sf).select("a").collect()) == sorted(ids)
    assert "%" not in ORACLES[name]


def test_split_double_is_split_amount_without_python(spark, sf):
    from tidemark.operators.table_functions import register_table_functions
    from tidemark.plans.streams import udtf_flatmap

    register_table_functions(spark)
    values = "VALUES (3.0D, 10.0D), (10.0D, 10.0D), (25.5D, 10.0D), (-2.0D, 10.0D), (null, 10.0D), (7.0D, null), (0.0D, 0.0D) AS t(n, most)"
    one, two = (spark.sql(f"SELECT n, most, part, q FROM {values}, LATERAL {f}(n, most)").collect() for f in ("split_amount", "split_double"))
    assert len(two) == 6 and sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert "Python" not in udtf_flatmap(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_lines_of_inventory_are_few_numbers_in_the_join(spark):
    """What the join of lines and orders shuffles is five columns, and all is made of them again, nulls and signs too."""
    from tidemark.plans import inputs

    rows = [(1, 7, 3, 14999.0, 2.0, "N", "O", "1996-05-01", 3), (2, -7, None, 15000.0, 3.0, None, "F", None, None), (3, None, 5, None, 4.0, "R", None, "0005-01-01", -2), (4, 10, -1, 5e4, None, "A|", "x", "1999-12-31", 2**29)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string, d string, l_linenumber int")
    packed = inputs.packed_lines(lines.withColumn("l_shipdate", F.to_timestamp("d")))
    assert packed.columns == ["l_orderkey", "packed", "q", "m", "t"]
    got = [tuple(r) for r in inputs.unpacked_lines(packed).orderBy("l_orderkey").collect()]
    want = [(1, "N", "slot2", "O", "3", "3", "1996", 9, 0, 2.0), (2, None, "slot-2", "F", None, None, None, None, 1, 3.0), (3, "R", None, None, "-2", "0", "0005", -6, None, 4.0), (4, "A|", "slot0", "x", str(2**29), "-1", "1999", 3 * 2**29, 3, None)]
    assert got == want


@pytest.mark.parametrize("name", ["allocation_plan", "hwm_resources", "available_inventory", "daily_inventory"])
def test_lines_meet_orders_once_in_a_query(spark, sf, monkeypatch, name):
    from tidemark.plans import inventory as plans

    made, inventory = [], plans.inventory
    monkeypatch.setattr(plans, "inventory", lambda *a: made.append(1) or inventory(*a))
    getattr(plans, name)(spark, sf)
    assert len(made) == 1
