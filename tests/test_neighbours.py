"""Pairs by signatures and probes against all pairs, and the quality of the clusterings."""

import math

import numpy as np
import pytest

from tidemark.operators import probes as P
from tidemark.operators import similarity as V


def _table(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in vectors], "vec_id long, embedding array<double>")


def _grouped(groups, each, noise, size=32, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, size))
    return [(g * each + k, centres[g] + noise * rng.standard_normal(size)) for g in range(groups) for k in range(each)]


def _all_pairs(vectors, distance):
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    return {(vectors[i][0], vectors[j][0]): 1 - d[i, j] for i, j in zip(*np.nonzero(d <= distance)) if i < j}


@pytest.mark.parametrize("distance, noise", [(0.6, 0.4), (0.9, 0.6), (1.25, 0.8)])
@pytest.mark.parametrize("tile", [1000, 50])
def test_pairs_by_probes_against_all_pairs(spark, monkeypatch, distance, noise, tile):
    """Recall of 0.9 or more, and no pair beyond the distance; with small tiles buckets are compared in many parts.

    Signatures as for 20,000 vectors: so few as these would all be compared.
    """
    monkeypatch.setattr(P, "TILE", tile)
    chosen = P.tables_for
    monkeypatch.setattr(P, "tables_for", lambda distance, n, recall: chosen(distance, 20_000, recall))
    vectors = _grouped(40, 15, noise)
    want = _all_pairs(vectors, distance)
    rows = P.similar_pairs(_table(spark, vectors), distance).collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in rows}
    assert len(rows) == len(got)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(abs(s - want[p]) < 1e-5 for p, s in got.items())


def test_recall_where_all_pairs_are_at_the_distance(spark):
    """Pairs just inside the distance are the hardest: with signatures of several signs, over four fifths of all
    comparisons are left out."""
    rng = np.random.default_rng(11)
    angle, vectors = 2 * math.asin(0.595 / 2), []
    for k in range(400):
        x, y = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 64)))
        y = y - (x @ y) * x
        vectors += [(k, x), (1000 + k, math.cos(angle) * x + math.sin(angle) * y / np.linalg.norm(y))]
    frame = _table(spark, vectors)
    unit = frame.selectExpr("vec_id as id", "embedding as v")
    bits, tables = P.tables_for(0.6, 50_000, 0.95)
    pairs = {(r["a"], r["b"]) for r in P._compared(P._placed(unit, bits, tables), 0.6, bits).collect()}
    assert sum((k, 1000 + k) in pairs for k in range(400)) >= 0.9 * 400
    assert bits >= 6 and tables * 2**P.FLIPS / 2**bits < 0.2


def test_more_vectors_have_longer_signatures():
    bits = [P.tables_for(0.6, n, 0.95)[0] for n in (1_000, 1_000_000, 1_000_000_000)]
    assert bits == sorted(bits) and bits[0] < bits[-1]
    assert P.tables_for(2.0, 100, 0.95)[0] >= 1


def test_a_third_of_the_vectors_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(P, "TILE", 20)
    monkeypatch.setattr(P, "SHARE", 10)
    rng = np.random.default_rng(17)
    x = rng.standard_normal(32)
    vectors = [(k, x + 0.01 * rng.standard_normal(32)) for k in range(100)] + [(1000 + k, rng.standard_normal(32)) for k in range(200)]
    got = {(r["a"], r["b"]) for r in P.similar_pairs(_table(spark, vectors), 0.2).collect()}
    assert got == set(_all_pairs(vectors, 0.2)) and len(got) == 4950


def test_copies_and_odd_vectors(spark):
    x, y = [1.0, 2.0, 2.0], [2.0, 1.0, 2.0]
    rows = [(3, x), (1, x), (2, [2.0, 4.0, 4.0]), (4, y), (5, None), (6, [0.0] * 3), (7, [math.nan, 1, 1]), (8, [math.inf, 1, 1]), (9, [1.0, 2.0]), (None, x), (3, x), (10, [])]
    got = {(r["a"], r["b"], r["similarity"]) for r in P.similar_pairs(_table(spark, rows), 0.6).collect()}
    d = math.dist([1 / 3, 2 / 3, 2 / 3], [2 / 3, 1 / 3, 2 / 3])
    assert got == {(1, 2, 1.0), (1, 3, 1.0), (1, 4, round(1 - d, 6))}
    assert P.similar_pairs(_table(spark, []), 0.6).count() == 0


def test_signature_clusters_hold_near_vectors(spark):
    """Two vectors share eight signs with probability (1 - angle / pi) ** 8; the share over pairs of known angle is that."""
    rng = np.random.default_rng(23)
    angle, vectors = 0.3, []
    for k in range(600):
        x, y = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 16)))
        y = y - (x @ y) * x
        vectors += [(k, x), (1000 + k, math.cos(angle) * x + math.sin(angle) * y / np.linalg.norm(y))]
    of = {r["id"]: r["cluster"] for r in V.lsh_clusters(_table(spark, vectors)).collect()}
    assert len(of) == 1200
    together = sum(of[k] == of[1000 + k] for k in range(600)) / 600
    assert abs(together - (1 - angle / math.pi) ** 8) < 0.12
    assert sum(of[k] == of[k + 1] for k in range(599)) / 599 < 0.05


def test_kmeans_finds_groups_and_lowers_its_objective(spark):
    vectors = _grouped(6, 40, 0.15, seed=29)
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1)[:, None]

    def objective(k):
        of = {r["id"]: r["cluster"] for r in V.kmeans_clusters(_table(spark, vectors), k).collect()}
        assert set(of) == {i for i, _ in vectors} and set(of.values()) <= set(range(k))
        named = np.array([of[i] for i, _ in vectors])
        return sum(((x[named == c] - x[named == c].mean(0)) ** 2).sum() for c in set(named.tolist())), of

    costs = [objective(k)[0] for k in (2, 4, 6)]
    assert costs[0] > costs[1] > costs[2]
    cost, of = objective(6)
    best = sum(((x[40 * g : 40 * g + 40] - x[40 * g : 40 * g + 40].mean(0)) ** 2).sum() for g in range(6))
    assert cost < 2.5 * best
    assert objective(6)[1] == of


def test_kmeans_with_fewer_vectors_than_clusters(spark):
    """A cluster that no vector is nearest to has no row; equal vectors are in one cluster."""
    rows = [(k, [1.0, 0.0]) for k in range(5)] + [(9, [0.0, 1.0])]
    of = {r["id"]: r["cluster"] for r in V.kmeans_clusters(_table(spark, rows), 4).collect()}
    assert len({of[k] for k in range(5)}) == 1 and of[9] != of[0]


def test_links_of_similar_vectors(spark, monkeypatch):
    """Counts and components are those of the pairs, copies included; vectors that no one can compare have no link."""
    monkeypatch.setattr(P, "TILE", 20)
    monkeypatch.setattr(P, "STEP", 7)
    rng = np.random.default_rng(59)
    x = rng.standard_normal((90, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200 + k, x[k % 3].tolist()) for k in range(6)] + [(300, None), (301, [0.0] * 6)]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in P.similar_links(_table(spark, rows), 0.6).collect()}
    ids, y = [k for k, _ in rows[:-2]], np.array([v for _, v in rows[:-2]])
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    near = np.linalg.norm(y[:, None] - y[None], axis=2) <= 0.6
    at = P.similar_pairs(_table(spark, rows[:90]), 0.6).count()
    assert at == (near[:90, :90].sum() - 90) // 2, "all pairs are found here"
    root = list(ids)
    for _ in ids:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
    assert got == {k: (int(near[i].sum()) - 1, root[i]) for i, k in enumerate(ids)} | {300: (0, 300), 301: (0, 301)}


def test_pairs_of_tiles_are_each_once(spark, monkeypatch):
    from tidemark.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK_ROWS", 8)
    vectors = spark.createDataFrame([(k, k % 2, [float(k), 1.0]) for k in range(60)], "vec_id long, label int, embedding array<double>")
    got = sorted((r["a"], r["b"], round(r["score"], 6)) for r in similarity.pairwise(vectors, within="label").collect())
    assert got == [(a, b, round(2**0.5 - (b - a), 6)) for a in range(60) for b in range(a + 2, 60, 2)]


def test_blocks_of_all_pairs_are_shuffled_once(spark, monkeypatch):
    """Where blocks meet, nothing is shuffled: a vector goes to its own block only, however many others that meets."""
    from tidemark.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK_ROWS", 8)
    monkeypatch.setattr(similarity, "SCORED_ROWS", 3)
    vectors = spark.createDataFrame([(k, k % 3, [float(k % 11), 1.0]) for k in range(90)] + [(90, None, [0.0, 1.0]), (91, 0, None)], "vec_id long, label int, embedding array<double>")
    found = similarity.pairwise(vectors, within="label")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = sorted((r["a"], r["b"], round(r["score"], 6)) for r in found.collect())
    assert got == [(a, b, round(2**0.5 - abs(a % 11 - b % 11), 6)) for a in range(90) for b in range(a + 3, 90, 3)]


def test_links_of_all_pairs_leave_blocks_unshuffled(spark, monkeypatch):
    """At nearly a right angle all vectors meet, each two blocks once and nothing shuffled for it; the links are exact."""
    monkeypatch.setattr(P, "TILE", 30)
    monkeypatch.setattr(P, "STEP", 7)
    met, compared = [], P.met_blocks
    monkeypatch.setattr(P, "met_blocks", lambda *a: met.append(compared(*a)) or met[-1])
    rng = np.random.default_rng(61)
    x = np.concatenate([rng.standard_normal((150, 24)) + [3.0, *[0.0] * 23], rng.standard_normal((20, 24)) * 0.1 - [3.0, *[0.0] * 23]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500 + k, (2 * x[k]).tolist()) for k in range(9)] + [(600, None), (601, [1.0, 2.0]), (602, [-1.0, 2.5])]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in P.similar_links(_table(spark, rows), 1.25).collect()}
    plan = met[0]._jdf.queryExecution().executedPlan().toString()
    assert len(met) == 2 and "CartesianProduct" in plan and "Exchange" not in plan
    ids, y = [k for k, _ in rows[:-3]], x[[*range(170), *range(9)]]
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    near = np.linalg.norm(y[:, None] - y[None], axis=2) <= 1.25
    root = list(ids)
    for _ in ids:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
    assert len(set(root)) > 1 and got == {k: (int(near[i].sum()) - 1, root[i]) for i, k in enumerate(ids)} | {600: (0, 600), 601: (1, 601), 602: (1, 601)}


def test_products_at_the_distance_are_exact():
    rng = np.random.default_rng(67)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 200, 64)))
    d = np.sqrt(2 - 2 * np.einsum("ij,ij->i", x, y))
    for k in range(200):  # a distance that a pair has, and the next one below it
        for distance in (d[k], np.nextafter(d[k], 0)):
            least = P._least_product(distance)
            assert P._within(*(v[k : k + 1].astype(np.float32) for v in (x, y)), x[k : k + 1], y[k : k + 1], least)[0, 0] == (d[k] <= distance)
    assert P._least_product(2.5) < -1 and np.sqrt(2 - 2 * P._least_product(1.25)) <= 1.25 < np.sqrt(2 - 2 * np.nextafter(P._least_product(1.25), -1))
