"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length have cosine >= c exactly where they are at most eps = sqrt(2 - 2c) apart. They are turned to
their principal axes, put in grid cells of side eps on the leading ones and sorted by cell; the sorted sequence is cut
in blocks. Two blocks are joined only if the boxes of their leading coordinates, and of the length that the other axes
leave, are within eps of each other, and inside a pair of blocks the join halves both sequences again and again and
leaves out halves whose boxes are too far apart; what is left is one matrix product. A block goes once to each square
of TILE by TILE blocks that it has a pair in. Only sums and links of a spanning forest leave a task, never pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_batches import record_batch
from tidemark.operators.graph import connected_components
from tidemark.operators.indexing import starts_of_tasks
from tidemark.sources.scratch import written

#: Leading axes that cells are made of, and those that boxes are.
AXES, BOX_AXES = 8, 32
#: Vectors of a block at most, and of a leaf of the recursion; bytes of a block at most, if it has more than a leaf.
BLOCK, LEAF, BLOCK_BYTES = 8192, 64, 4 << 20
#: Blocks on either side of the pairs that one task joins.
TILE = 4
#: Room for the rounding of projections, in distance.
SLACK = 1e-7


def usable(vector: F.Column) -> F.Column:
    """Not null, not empty, not all zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links are pairs of rows with cosine >= least in double precision; n_links counts the others a row is linked with,
    component_id is the smallest id reachable. Equal vectors are joined once and counted with their number. Vectors of
    each length are joined among themselves. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null id, have no link. Rows that repeat an id are separate vectors for counting but one for
    components. Other columns are left out. An empty table gives an empty result. least is over 0.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(rows.withColumn("ok", usable(F.col("v")) & F.col("vec_id").isNotNull()), "vectors")
    none = rows.select("*", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = [r["d"] for r in rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # one row a length
    if not lengths:
        return none.select("vec_id", "n_links", "component_id", "kept")
    copies = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    same = written(copies.withColumn("key", F.monotonically_increasing_id()), "distinct-vectors")
    found = reduce(DataFrame.union, [_joined(*_blocks(same.where(F.size("v") == d), d, least, block), d, least) for d in lengths])
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("key"), "n")
    roots = connected_components(found.where("b is not null"), "a", "b")
    linked = links.join(roots, links.key == roots.node, "left").join(same.select("key", "rep", "v"), "key").select("n", "v", "rep", F.coalesce("component", "key").alias("root"))
    least_id = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_vector = linked.select("n", "v", "root").join(least_id, "root")
    kept = F.col("vec_id") == F.col("component_id")
    answered = rows.where("ok").select("vec_id", "v").join(of_vector, "v").select("vec_id", (F.col("n") - 1).alias("n_links"), "component_id", kept.alias("kept"))
    return answered.unionByName(none.where("not ok").select("vec_id", "n_links", "component_id", "kept"))


def _axes(same: DataFrame, dim: int) -> np.ndarray:
    """The leading principal axes of the unit vectors, (dim, BOX_AXES). Sums of dim x dim products, one row a task."""
    schema = pa.schema([("k", pa.int32()), ("s", pa.float64())])

    def sums(batches):
        total = np.zeros((dim + 1, dim))
        for batch in batches:
            x = _unit(batch.column(0), dim)
            total[:dim] += x.T @ x
            total[dim] += x.sum(0)
        yield record_batch(schema, [np.arange(total.size, dtype=np.int32), total.ravel()])

    got = same.select("v").mapInArrow(sums, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas().sort_values("k")["s"].to_numpy()
    n = max(1, same.count())
    total = got.reshape(dim + 1, dim)
    mean = total[dim] / n
    return np.linalg.eigh(total[:dim] / n - np.outer(mean, mean))[1][:, ::-1][:, : min(BOX_AXES, dim)]


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _leading(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The coordinates on the leading axes and the length of the rest: no two vectors are nearer than these are."""
    y = x @ axes
    return np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))])


def _blocks(same: DataFrame, dim: int, least: float, block: int) -> tuple[DataFrame, np.ndarray]:
    """(block, ids, copies, unit, lo, hi), packed runs of the grid order, and the leading axes."""
    eps = math.sqrt(2 - 2 * least)
    axes = _axes(same, dim)
    order = [f"c{i}" for i in range(min(AXES, dim))]
    cells = ", ".join(f"{c} int" for c in order)
    schema = pa.schema([*[(c, pa.int32()) for c in order], ("key", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary())])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(0), dim)
                cell = np.floor(x @ axes[:, :AXES] / max(eps, 1e-6)).astype(np.int32)
                yield record_batch(schema, [*cell.T, batch.column(1), batch.column(2), [r.tobytes() for r in x]])

    placed = same.select("v", "key", "copies").mapInArrow(place, f"{cells}, key long, copies long, unit binary")
    order.append("key")
    block = max(LEAF, min(block, same.count() // 16, BLOCK_BYTES // (8 * dim)))
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        at = 0
        for batch in batches:
            yield record_batch(numbered, [pa.array([TaskContext.get().partitionId()] * batch.num_rows, pa.int32()), np.arange(at, at + batch.num_rows), *batch.columns])
            at += batch.num_rows

    numbered = pa.schema([("task", pa.int32()), ("at", pa.int64()), ("key", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary())])
    ordered = written(dealt.select("key", "copies", "unit").mapInArrow(number, "task int, at long, key long, copies long, unit binary"), "grid-order")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["task", "at"])
        x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(-1, dim)
        y = _leading(x, axes)
        ids, copies = (rows[c].to_numpy(np.int64).tobytes() for c in ("key", "copies"))
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "ids": [ids], "copies": [copies], "unit": [x.tobytes()], "lo": [y.min(0).tolist()], "hi": [y.max(0).tolist()]})

    cut = ordered.join(F.broadcast(starts_of_tasks(ordered)), "task")  # one row a task
    cut = cut.withColumn("block", F.expr(f"(before + at) div {block}"))
    return written(cut.groupBy("block").applyInPandas(pack, "block long, ids binary, copies binary, unit binary, lo array<double>, hi array<double>"), "blocks"), axes


def _joined(blocks: DataFrame, axes: np.ndarray, dim: int, least: float) -> DataFrame:
    """(a, b, n): partial link counts n of a, itself included, or links a-b of a spanning forest."""
    eps = math.sqrt(2 - 2 * least) + SLACK
    width = max(eps, 1e-6)
    box = blocks.select("block", "lo", "hi")
    # boxes within eps of each other share or neighbour a cell of the first axis
    near = box.select("*", F.explode(F.sequence(F.floor(F.col("lo")[0] / width).cast("long"), F.floor(F.col("hi")[0] / width).cast("long") + 1)).alias("cell"))
    other = box.select(F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    other = other.select("*", F.explode(F.sequence(F.floor(F.col("lo2")[0] / width).cast("long"), F.floor(F.col("hi2")[0] / width).cast("long") + 1)).alias("cell"))
    apart = F.aggregate(
        F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0))),
        F.lit(0.0), lambda s, g: s + g * g,
    )
    pairs = near.join(other, "cell").where((F.col("block") <= F.col("other")) & (apart <= eps * eps)).select("block", "other").distinct()
    tile = F.struct(F.expr(f"block div {TILE}").alias("x"), F.expr(f"other div {TILE}").alias("y"))
    tiles = written(pairs.groupBy(tile.alias("tile")).agg(F.collect_list(F.struct("block", "other")).alias("pairs")), "tiles")  # at most TILE * TILE
    used = tiles.select("tile", "pairs", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["block"], p["other"]))))).alias("block"))
    held = used.join(blocks.select("block", "ids", "copies", "unit"), "block").select("tile", "pairs", "block", "ids", "copies", "unit")

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = {b: (i, c, u) for b, i, c, u in zip(rows["block"], rows["ids"], rows["copies"], rows["unit"])}
        got = [_pair(p["block"] == p["other"], *packed[p["block"]], *packed[p["other"]]) for p in rows["pairs"].iloc[0]]
        columns = [[v for part in got for v in part[k]] for k in range(3)]
        return pd.DataFrame({c: pd.array(v, "Int64") for c, v in zip("abn", columns)})

    def _pair(alone: bool, ids: bytes, copies: bytes, unit: bytes, ids2: bytes, copies2: bytes, unit2: bytes) -> list:
        (i, c, x), (j, d, y) = ((np.frombuffer(k, np.int64), np.frombuffer(n, np.int64), np.frombuffer(u, np.float64).reshape(-1, dim)) for k, n, u in ((ids, copies, unit), (ids2, copies2, unit2)))
        p, q = _leading(x, axes), _leading(y, axes)
        n, m = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64)
        links: list[tuple[int, int]] = []
        shift = 0 if alone else len(i)
        label = np.arange(shift + len(j))  # the tree that each vector of the two blocks is in so far

        todo = [(0, len(i), 0, len(j))]
        while todo:
            a, b, e, f = todo.pop()
            gap = np.maximum(0, np.maximum(p[a:b].min(0) - q[e:f].max(0), q[e:f].min(0) - p[a:b].max(0)))
            if gap @ gap > eps * eps:
                continue
            if max(b - a, f - e) > LEAF:
                s, t = (a + b) // 2, (e + f) // 2
                left = [(a, s), (s, b)] if b - a > LEAF else [(a, b)]
                right = [(e, t), (t, f)] if f - e > LEAF else [(e, f)]
                todo += [(*u, *w) for u in left for w in right if not alone or u <= w]
                continue
            same = alone and a == e
            hit = x[a:b] @ y[e:f].T >= least
            if same:
                np.fill_diagonal(hit, True)
            if not hit.any():
                continue
            n[a:b] += hit @ d[e:f]
            if not same:
                m[e:f] += hit.T @ c[a:b]
            for r in np.flatnonzero(hit.sum(1) > (1 if same else 0)):
                hits = e + np.flatnonzero(hit[r])
                trees, at = np.unique(label[shift + hits], return_index=True)
                for tree, k in zip(trees, at):
                    if tree != label[a + r]:
                        links.append((int(i[a + r]), int(j[hits[k]])))
                        label[label == tree] = label[a + r]
        if alone:
            n += m
            rows = [(int(k), None, int(v)) for k, v in zip(i, n)]
        else:
            rows = [(int(k), None, int(v)) for k, v in zip([*i, *j], [*n, *m]) if v]
        rows += [(k, o, None) for k, o in links]
        return [list(col) for col in zip(*rows)] if rows else [[], [], []]

    return written(held.groupBy("tile").applyInPandas(join, "a long, b long, n long"), "vector-links")
