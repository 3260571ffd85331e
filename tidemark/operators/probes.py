"""Pairs of similar vectors by signatures of several tables, with probes of the nearest other buckets.

In each table a vector's signature is the signs of its projections on a few random directions. A vector looks into its own
bucket and into those that it would be in if its least certain signs fell the other way. How many signs and tables there
are follows from the distance asked for and the number of vectors: the cheapest that find the wanted share of pairs at
just that distance. What a bucket brings together is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from math import asin, ceil, cos, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import arrays_of, met_blocks
from tidemark.operators.graph import connected_components
from tidemark.sources.scratch import written

#: Least certain signs of which all combinations are probed.
FLIPS = 2
#: Most signs of a signature.
BITS = 24
#: Vectors of a tile of a bucket, those that are compared at once, and what moving a vector to a bucket costs, in
#: comparisons.
TILE, STEP, MOVED = 8000, 1000, 200
#: A bucket is hot if it has more than one in so many of all entries, so there are fewer than this.
SHARE = 1000


def tables_for(distance: float, n: int, recall: float) -> tuple[int, int]:
    """(bits, tables): the cheapest with which a pair of unit vectors at the distance is found with probability `recall`.

    The probability that one table finds a pair is that of two normal variables of the pair's correlation for each
    direction; it is measured on 20,000 drawn pairs, whatever the vectors.
    """
    angle = 2 * asin(min(distance, 2.0) / 2)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, BITS))
    y = cos(angle) * x + (1 - cos(angle) ** 2) ** 0.5 * rng.standard_normal(x.shape)
    best = None
    for bits in range(1, BITS + 1):
        codes, masks = _codes(x[:, :bits])
        others, _ = _codes(y[:, :bits])
        found = ((codes[:, None] ^ masks) == others[:, None]).any(1).mean()
        if found <= 0:
            break
        tables = 1 if found >= recall else ceil(log(1 - recall) / log(1 - found))
        cost = tables * masks.shape[1] * (n * MOVED + n * n / 2**bits)
        if best is None or cost < best[0]:
            best = (cost, bits, tables)
    return best[1], best[2]


def _codes(projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, masks): the signs as a number, and for each row which bits each probe flips, none by the first."""
    bits = projected.shape[1]
    powers = np.int64(1) << np.arange(bits)
    codes = (projected >= 0) @ powers
    least = powers[np.argsort(np.abs(projected), axis=1, kind="stable")[:, : min(FLIPS, bits)]]
    masks = np.zeros((len(projected), 1), np.int64)
    for k in range(least.shape[1]):
        masks = np.hstack([masks, masks | least[:, k : k + 1]])
    return codes, masks


def _projected(x: np.ndarray, table: int, bits: int) -> np.ndarray:
    return x @ np.random.default_rng([table, x.shape[1]]).standard_normal((x.shape[1], bits))


def _found_here(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, first: np.ndarray, table: int, bits: int) -> np.ndarray:
    """Whether row i of x, looking for row j of y in this table, is the one that reports the pair: no table before finds
    it from either side, and if both find each other in this one, the row that is `first` does."""
    here = np.ones(len(i), bool)
    for t in range(table + 1):
        (of_x, flips_x), (of_y, flips_y) = (_codes(_projected(v, t, bits)) for v in (x, y))
        back = ((of_y[:, None] ^ flips_y)[j] == of_x[i, None]).any(1)
        if t == table:
            return here & (first | ~back)
        here &= ~back & ~((of_x[:, None] ^ flips_x)[i] == of_y[j, None]).any(1)
    return here


def similar_pairs(vectors: DataFrame, distance: float, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, similarity = 1 - distance), a < b, of vectors whose unit vectors are at most `distance` apart.

    No pair beyond the distance is there; one at the distance is found with probability `recall`, nearer ones with more.
    Of equal unit vectors the one of smallest id stands for all, and each other is paired with that one alone. Vectors of
    different lengths aren't compared. Null, zero and non-finite vectors and null ids have no pairs; of rows that repeat
    an id with other vectors each is compared and reports its own pairs; other columns are left out.
    """
    unit = written(_units(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))).where("u is not null").select("id", F.col("u").alias("v")), "unit-vectors")
    nodes = written(unit.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "distinct-vectors")
    copies = unit.join(nodes.select("v", F.col("id").alias("first")), "v").where("id <> first")
    bits, tables = tables_for(distance, nodes.count(), recall)
    equal = copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    return _compared(written(_placed(nodes, bits, tables), "signatures"), distance, bits).unionByName(equal)


def _pairs(bucket: str, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, hits) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "similarity": np.round(1 - d, 6)}) for i, j, d in hits])


def similar_links(vectors: DataFrame, distance: float, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id), one row per row of vectors, of the links that similar_pairs' comparisons find.

    n_links counts the other rows at most `distance` apart that are found, all copies of a vector included; component_id is
    the smallest id reachable. Copies are compared once and counted with their number. Rows without a usable vector or an
    id have no link. Only counts and links of a spanning forest leave a task, never pairs.
    """
    rows = written(_units(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))).select("id", "u"), "unit-vectors")
    groups = rows.where("u is not null").groupBy("u").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    nodes = written(groups.withColumn("key", F.monotonically_increasing_id()), "distinct-vectors")
    bits, tables = tables_for(distance, nodes.count(), recall)
    def forest(bucket: str, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, hits) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        of_a, of_b, tree, total, links = at[: len(a)], at[len(a) :], np.arange(len(ids)), np.zeros(len(ids), np.int64), []
        for i, j, _ in hits:
            np.add.at(total, of_a[i], m[j])
            np.add.at(total, of_b[j], n[i])
            for r, held in zip(*_runs(of_a[i], of_b[j])):
                others, first = np.unique(tree[held], return_index=True)
                for t, k in zip(others, held[first]):
                    if t != tree[r]:
                        links.append((ids[r], ids[k]))
                        tree[tree == t] = tree[r]
        some = np.flatnonzero(total)
        return pd.DataFrame({
            "a": np.concatenate([ids[some], np.array([x for x, _ in links], np.int64)]), "b": pd.array([None] * len(some) + [y for _, y in links], "Int64"),
            "n": pd.array([*total[some].tolist(), *[None] * len(links)], "Int64"),
        })

    told = "a long, b long, n long"
    if tables == 1 and bits <= FLIPS:  # every probe looks everywhere
        found = written(_linked(nodes.select(F.size("u").alias("g"), "key", F.col("u").alias("v"), "copies"), distance, told), "vector-links")
    else:
        placed = written(_placed(nodes.select(F.col("key").alias("id"), F.col("u").alias("v"), "copies"), bits, tables), "signatures")
        found = written(_compared(placed, distance, bits, forest, told), "vector-links")
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "key")
    # rows that repeat an id are one for components
    same = rows.where("u is not null").join(nodes.select("u", "key"), "u").select("id", "key")
    several = same.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").select("id", "a")
    edges = found.where("b is not null").select("a", "b").union(same.join(several, "id").select("a", F.col("key").alias("b")))
    roots = connected_components(edges, "a", "b").withColumnRenamed("node", "key")
    of_node = written(nodes.join(counts, "key", "left").join(roots, "key", "left").select("u", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("root")), "links-of-vectors")
    told = of_node.join(of_node.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("u", "n_links", "component_id")
    return rows.join(told, "u", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _linked(nodes: DataFrame, distance: float, schema: str) -> DataFrame:
    """(a, b, n): the links of all pairs of nodes (g, key, v, copies) of one g at most `distance` apart, as counts (b null)
    for each two blocks and as the links of a forest (n null) within them.

    Products are made with numbers of 32 bits, and what their rounding leaves open is computed with 64.
    """
    least = _least_product(distance)

    def compared(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(ids, labels, numbers of links, links that join labels) of a row of met_blocks."""
        (x, a, n, of_x), (y, b, m, of_y) = arrays_of(batch, k, "key", "copies", "label")
        same = batch["same"][k].as_py()
        ids, label, from_b = (a, of_x, 0) if same else (np.concatenate([a, b]), np.concatenate([of_x, of_y]), len(a))
        label = np.unique(label, return_inverse=True)[1]
        total, links = np.zeros(len(ids)), []
        low_x, low_y = x.astype(np.float32), y.astype(np.float32)
        for s in range(0, len(a), STEP):
            for t in range(s if same else 0, len(b), STEP):
                i, j = slice(s, s + STEP), slice(t, t + STEP)
                hit = _within(low_x[i], low_y[j], x[i], y[j], least)
                if same and s == t:
                    np.fill_diagonal(hit, False)
                weight = hit.astype(np.float32 if max(n[i].sum(), m[j].sum()) < 1 << 24 else np.float64)
                total[s : s + hit.shape[0]] += weight @ m[j].astype(weight.dtype)
                if not (same and s == t):
                    total[from_b + t : from_b + t + hit.shape[1]] += n[i].astype(weight.dtype) @ weight
                links += _joining(label, s, from_b + t, hit)
        return ids, label, total, links

    def labelled(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, label, _, _ = compared(batch, k)
                yield pa.RecordBatch.from_pydict({"key": ids, "label": ids[np.unique(label, return_index=True)[1]][np.unique(label, return_inverse=True)[1]]})

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, _, total, links = compared(batch, k)
                some, (p, q) = np.flatnonzero(total), np.array(links, np.int64).reshape(-1, 2).T
                nothing = lambda size: pa.nulls(size, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), nothing(len(some)), pa.array(total[some].astype(np.int64))], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(ids[q]), nothing(len(p))], names=["a", "b", "n"])

    # components of each block by itself first: two blocks then have links only where these aren't joined yet
    alone = met_blocks(nodes.withColumn("label", F.col("key")), TILE, "key", "copies", "label").where("same")
    own = written(alone.mapInArrow(labelled, "key long, label long"), "labels-in-blocks")
    found = met_blocks(nodes.join(own, "key"), TILE, "key", "copies", "label").mapInArrow(run, schema)
    return found.unionByName(own.where("key <> label").select(F.col("key").alias("a"), F.col("label").alias("b"), F.lit(None).cast("long").alias("n")))


def _least_product(distance: float) -> float:
    """The least product of two unit vectors whose distance, sqrt(2 - 2 * product), isn't more than `distance`."""
    near = lambda p: np.sqrt(np.maximum(0.0, 2 - 2 * p)) <= distance
    p = np.float64(1 - distance * distance / 2)
    while near(p):
        p = np.nextafter(p, -np.inf)
        if p < -2:
            return float(p)
    while not near(p):
        p = np.nextafter(p, np.inf)
    return float(p)


def _within(low_x: np.ndarray, low_y: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which products of rows of x and y, unit vectors, are `least` or more. low_x, low_y: the rows in 32 bits."""
    product = low_x @ low_y.T
    margin = (x.shape[1] + 8) * 2.0**-23
    hit, sure = product >= np.float32(least - margin), product >= np.float32(least + margin)
    i, j = np.nonzero(hit ^ sure)
    hit[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= least
    return hit


def _joining(label: np.ndarray, s: int, t: int, hit: np.ndarray) -> list[tuple[int, int]]:
    """Links among those of hit, between places from s and places from t on, that join components; label is updated."""
    links: list[tuple[int, int]] = []
    while True:
        x, y = label[s : s + hit.shape[0]], label[t : t + hit.shape[1]]
        if not hit.size or (x == x[0]).all() and (y == x[0]).all():
            return links
        apart = hit & (x[:, None] != y[None])
        rows = np.flatnonzero(apart.any(1))
        if not len(rows):
            return links
        to = np.arange(len(label))

        def root(v: int) -> int:
            while to[v] != v:
                to[v] = v = to[to[v]]
            return v

        for p, q in zip(rows.tolist(), apart[rows].argmax(1).tolist()):
            u, v = root(int(x[p])), root(int(y[q]))
            if u != v:
                to[max(u, v)] = min(u, v)
                links.append((s + p, t + q))
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def _runs(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each value of `of`, which comes in order, with its values."""
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    return of[starts], np.split(values, starts[1:]) if len(starts) else []


def _units(rows: DataFrame) -> DataFrame:
    """rows (id, v) with u, the vector at length 1; null for null ids and for null, zero and non-finite vectors."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    good = "id is not null and norm > 0 and norm < double('Infinity') and not isnan(norm)"
    return rows.withColumn("norm", norm).withColumn("u", F.expr(f"if({good}, transform(v, x -> x / norm), null)")).drop("norm")


def _placed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(bucket, own, id, v): each vector in its own bucket of each table and, not own, in those that it probes."""

    def run(batches):
        for batch in batches:
            for size, part in batch.groupby(batch["v"].map(len)):
                ids, kept, copies = part["id"].to_numpy(), part["v"].to_numpy(), part["copies"].to_numpy() if "copies" in part else 1
                x = np.stack(kept)
                for t in range(tables):
                    codes, masks = _codes(_projected(x, t, bits))
                    for p in range(masks.shape[1]):
                        names = [f"{size}.{t}.{c}" for c in (codes ^ masks[:, p]).tolist()]
                        yield pd.DataFrame({"bucket": names, "own": p == 0, "id": ids, "v": kept, "copies": copies})

    return nodes.mapInPandas(run, f"bucket string, own boolean, id {dict(nodes.dtypes)['id']}, v array<double>, copies long")


def _compared(placed: DataFrame, distance: float, bits: int, made_of: Callable = _pairs, schema: str | None = None) -> DataFrame:
    """(a, b, similarity), or what `made_of` makes, of the pairs of each two tiles that hold, found by products of STEP by STEP vectors. A pair that
    several buckets hold is reported by one of them, so pairs aren't shuffled.

    made_of(bucket, ids, ids of the other tile, their copies, the other's, (i, j, distance) of each product) is a pandas frame.
    """
    sizes = placed.groupBy("bucket").agg(F.count_if("own").alias("n_own"), F.count("*").alias("n"))
    sizes = written(sizes.where("n_own > 0 and n > 1"), "bucket-sizes")
    hot = F.col("n") * SHARE > F.lit(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    few = sizes.where(hot)  # fewer than SHARE rows
    rest = placed.join(F.broadcast(few.select("bucket")), "bucket", "left_anti")
    told = placed.join(F.broadcast(few), "bucket").unionByName(rest.join(sizes.where(~hot), "bucket"))
    told = told.withColumn("tile", F.pmod(F.xxhash64("id"), F.ceil(F.when(F.col("own"), F.col("n_own")).otherwise(F.col("n")) / TILE)))
    rows = F.collect_list(F.struct("id", "v", "copies"))
    own = told.where("own").groupBy("bucket", "tile").agg(rows.alias("others"))
    seek = told.withColumn("tile", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / TILE))).groupBy("bucket", F.col("tile").alias("part")).agg(rows.alias("rows"), F.any_value("n_own").alias("n_own"))
    # each part meets each tile of the bucket, and (bucket, tile) spreads a hot bucket over tasks
    met = seek.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_own") / TILE) - 1))).join(own, ["bucket", "tile"])

    def run(batches):
        for batch in batches:
            for bucket, rows, others in zip(batch["bucket"], batch["rows"], batch["others"]):
                a, b = (np.array([r["id"] for r in side]) for side in (rows, others))
                n, m = (np.array([r["copies"] for r in side], np.int64) for side in (rows, others))
                x, y = (np.stack([r["v"] for r in side]) for side in (rows, others))
                hits = (hit(a[s : s + STEP], b[t : t + STEP], x[s : s + STEP], y[t : t + STEP], s, t, int(bucket.split(".")[1])) for s in range(0, len(a), STEP) for t in range(0, len(b), STEP))
                yield made_of(bucket, a, b, n, m, hits)

    def hit(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, s: int, t: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))
        i, j = np.nonzero(d <= distance)
        i, j = i[a[i] != b[j]], j[a[i] != b[j]]
        here = _found_here(x, y, i, j, a[i] < b[j], table, bits)
        return i[here] + s, j[here] + t, d[i[here], j[here]]

    of_id = dict(placed.dtypes)["id"]
    return met.select("bucket", "rows", "others").mapInPandas(run, schema or f"a {of_id}, b {of_id}, similarity double")
