"""Exact nearest neighbours: cells with centres and radii, and the triangle inequality to leave blocks of vectors out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

#: Vectors of a block, at most.
BLOCK_ROWS = 2000
#: Cells at most, and vectors of a group that are worth a cell of their own.
CELLS, CELL_ROWS = 64, 256
#: Vectors, by least hash of the id, that the cells' centres are fitted on, and rounds of fitting.
FIT_ROWS, FIT_ROUNDS = 20_000, 5
#: Blocks that a vector is searched for in before the others are held against what has been found.
FIRST = 4


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))


def centres_of(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of k-means that begins with vectors far from one another."""
    if not len(x):
        return x
    chosen, near = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < cells and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    centres = x[chosen]
    for _ in range(FIT_ROUNDS):
        cell = distances(x, centres).argmin(1)
        sums, sizes = np.zeros_like(centres), np.bincount(cell, minlength=len(centres))
        np.add.at(sums, cell, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)  # an empty cell keeps its centre
    return centres


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the n best columns of each row: by score to nine places, then by id."""
    if scores.shape[1] > n:
        least = np.partition(scores, -n, axis=1)[:, -n]
        i, j = np.nonzero(scores >= least[:, None] - 2e-9)
    else:
        i, j = np.nonzero(np.ones_like(scores, bool))
    order = np.lexsort((ids[j], -np.round(scores[i, j], 9), i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < n
    return i[kept], ids[j[kept]], scores[i[kept], j[kept]]


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _lists(i: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """Values of sorted rows i as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def _found(batch_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, n: int) -> list[pa.Array]:
    """Columns a, b, score and seen of the n best of y for each x."""
    i, b, score = best(ids, np.sqrt(x.shape[1]) - distances(x, y), n)
    return [pa.array(batch_ids), _lists(i, b, len(x)), _lists(i, score, len(x)), pa.array(np.full(len(x), len(y), np.int64))]


_FOUND = "a long, b array<long>, score array<double>, seen long"
_NAMES = ["a", "b", "score", "seen"]


def _blocks(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Blocks of at most BLOCK_ROWS vectors of one group and cell whose distances from the centre lie between lo and hi.

    Rows are sorted by group, cell and distance over all tasks, and cut as they come.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["v"])
            d = distances(x, centres) if len(x) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1)), pa.array(d.min(1))], names=[*batch.schema.names, "cell", "d"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            whole = pa.concat_batches(held)
            d = whole["d"].to_numpy()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [whole["g"][:1], whole["cell"][:1], pa.array([number - 1]), pa.array(d[:1]), pa.array(d[-1:]), pa.array([len(d)]), one(whole["id"]), one(whole["v"].flatten()), one(whole["asked"])]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["g", "cell", "block", "lo", "hi", "n", "ids", "vectors", "asked"])

        for batch in batches:
            g, cell = np.array(batch["g"].to_pylist(), object), batch["cell"].to_numpy()
            ends = [*(np.flatnonzero((g[1:] != g[:-1]) | (cell[1:] != cell[:-1])) + 1), batch.num_rows]
            start = 0
            for end in ends:
                while start < end:
                    if held and (held[0]["g"][0].as_py(), held[0]["cell"][0].as_py()) != (g[start], cell[start]) or sum(h.num_rows for h in held) >= BLOCK_ROWS:
                        yield block()
                    size = min(end - start, BLOCK_ROWS - sum(h.num_rows for h in held))
                    held.append(batch.slice(start, size))
                    start += size
        if held:
            yield block()

    fields = "g string, id long, v array<double>, asked boolean"
    in_cells = rows.mapInArrow(placed, f"{fields}, cell long, d double")
    dealt = in_cells.repartitionByRange("g", "cell", "d", "id").sortWithinPartitions("g", "cell", "d", "id")
    schema = "g string, cell long, block long, lo double, hi double, n long, ids array<long>, vectors array<double>, asked array<boolean>"
    return written(dealt.mapInArrow(cut, schema), "blocks")


def _merged(found: DataFrame, n: int) -> DataFrame:
    """(a, b, score, seen): the n best of all rows of one a."""
    pairs = F.flatten(F.collect_list(F.arrays_zip("b", "score")))
    order = F.array_sort(F.transform(pairs, lambda x: F.struct((-F.round(x["score"], 9)).alias("k"), x["b"].alias("b"), x["score"].alias("score"))))
    first = found.groupBy("a").agg(F.slice(order, 1, n).alias("x"), F.sum("seen").alias("seen"))
    return first.select("a", F.col("x.b").alias("b"), F.col("x.score").alias("score"), "seen")


def _searched(wanted: DataFrame, state: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """What each wanted (a, block) finds: a block meets those who want it in parts of at most about BLOCK_ROWS."""
    parts = wanted.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    asking = wanted.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).join(state.select("a", "v"), "a")
    asking = asking.groupBy("block", "part").agg(F.collect_list("a").alias("asking"), F.flatten(F.collect_list("v")).alias("x"))
    copies = blocks.select("block", "ids", "vectors").join(parts, "block").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, ids = (batch[c][k].values.to_numpy() for c in ("asking", "ids"))
                x, y = (batch[c][k].values.to_numpy().reshape(len(i), -1) for c, i in (("x", a), ("vectors", ids)))
                yield pa.RecordBatch.from_arrays(_found(a, x, ids, y, n), names=_NAMES)

    return asking.join(copies, ["block", "part"]).select("asking", "x", "ids", "vectors").mapInArrow(run, _FOUND)


def _reach(tau: Column, norm: Column) -> Column:
    """How far a block may begin and still matter: the n-th best distance and what rounding may do to it."""
    return tau + 1e-6 * (1 + norm + tau)


def nearest(rows: DataFrame, n: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b, score, seen) for each row that is asked for: its n nearest rows of the same group, itself included.

    rows: (g, id, v, asked), vectors of one length. b and score are arrays, the best first, by score (the square root of
    the length, less the distance) to nine places and then by id. seen: how many vectors it was compared with.

    Vectors lie in cells, those of a group and cell in blocks by distance from the centre. A vector is searched for in
    its own block first; the n-th best distance then rules out every block that begins further away. It goes on with the
    few blocks that may begin nearest, and with all others that are still within reach, so the result is exact. Where
    vectors lie evenly, nothing is out of reach and all are compared.
    """
    size = rows.agg(F.count("*").alias("rows"), F.count_distinct("g").alias("groups")).first()
    cells = int(np.clip(size["rows"] // max(1, size["groups"]) // cell_rows, 1, CELLS))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow()
    centres = centres_of(_matrix(sample["v"].combine_chunks()), cells)
    blocks = _blocks(rows, centres)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, asked = batch["ids"][k].values.to_numpy(), batch["asked"][k].values.to_numpy(zero_copy_only=False).astype(bool)
                y = batch["vectors"][k].values.to_numpy().reshape(len(ids), -1)
                x = y[asked]
                if len(x):
                    g, own = (pa.array([batch[c][k].as_py()] * len(x), t) for c, t in (("g", pa.string()), ("block", pa.int64())))
                    yield pa.RecordBatch.from_arrays([*_found(ids[asked], x, ids, y, n), g, own, _lists(np.repeat(np.arange(len(x)), x.shape[1]), x.ravel(), len(x))], names=[*_NAMES, "g", "own", "v"])

    state = written(blocks.select("g", "block", "ids", "vectors", "asked").mapInArrow(at_home, f"{_FOUND}, g string, own long, v array<double>"), "found-at-home")
    if blocks.groupBy("g").count().where("count > 1").limit(1).count() == 0:
        return state.select("a", "b", "score", "seen")

    radii = {r["cell"]: r for r in blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # CELLS rows
    lo, hi = (np.array([radii[c][x] if c in radii else np.inf * s for c in range(len(centres))]) for x, s in (("lo", 1), ("hi", -1)))
    last = F.sqrt(F.size("v")) - F.element_at("score", -1)
    tau = F.when(F.size("b") < n, F.lit(float("inf"))).otherwise(last)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))

    def cells_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, reach = distances(_matrix(batch["v"]), centres) if batch.num_rows else np.zeros((0, len(centres))), batch["reach"].to_numpy()
            i, cell = np.nonzero((np.maximum(d - hi, lo - d) <= reach[:, None]) & np.isfinite(lo))
            keys = [batch[c].take(pa.array(i)) for c in ("a", "g", "own")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(reach[i]), pa.array(cell), pa.array(d[i, cell])], names=["a", "g", "own", "reach", "cell", "d"])

    reaching = state.withColumn("reach", _reach(tau, norm)).select("a", "g", "own", "reach", "v")
    cells_of = reaching.mapInArrow(cells_within, "a long, g string, own long, reach double, cell long, d double")
    rings = blocks.groupBy("g", "cell").agg(F.collect_list(F.struct("block", "lo", "hi")).alias("rings"))
    bound = lambda r: F.greatest(F.col("d") - r["hi"], r["lo"] - F.col("d"), F.lit(0.0))
    within = F.filter("rings", lambda r: (bound(r) <= F.col("reach")) & (r["block"] != F.col("own")))
    wanted = cells_of.join(rings, ["g", "cell"]).select("a", F.explode(F.transform(within, lambda r: F.struct(r["block"].alias("block"), bound(r).alias("bound")))).alias("w")).select("a", "w.*")
    turn = F.row_number().over(Window.partitionBy("a").orderBy("bound", "block"))
    wanted = written(wanted.withColumn("turn", turn), "wanted-blocks")

    columns = ["a", "b", "score", "seen"]
    kept = state.select("a", "v", norm.alias("norm"))
    near = written(_merged(state.select(*columns).unionByName(_searched(wanted.where(F.col("turn") <= FIRST), state, blocks, n)), n), "found-near")
    limit = near.join(kept, "a").select("a", _reach(tau, F.col("norm")).alias("reach"))
    rest = written(wanted.where(F.col("turn") > FIRST).join(limit, "a").where("bound <= reach").select("a", "block"), "wanted-blocks")
    return _merged(near.unionByName(_searched(rest, state, blocks, n)), n)
