"""Packing documents into training sequences by harmonic classes.

A class j holds pieces of at most capacity/j tokens, and a sequence of class j holds exactly j of them, so a task
fills sequences from nothing but its own rows: no bin search, no shared state. As documents may be cut, a remainder
that would leave much padding in its class gives up a piece that fits a class exactly and passes the rest on.

A task's unfinished sequences (fewer than j pieces in each class, whatever the input) are filled again in groups of
tasks, level by level; what the last level leaves is a constant number of pieces, which are placed first-fit.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_batches import record_batch, slices
from tidemark.llm.vocabulary import read_ranks
from tidemark.sources.scratch import written

#: Classes: every reciprocal down to 1/32 of the capacity, then wider steps, as shorter pieces hold few tokens.
CLASSES = [*range(1, 33), 36, 40, 48, 56, 64, 80, 96, 128, 160, 192, 256, 384, 512, 1024, 2048]
#: A piece stays whole in its class if it leaves at most this share of its place as padding.
SLACK = 1 / 64
#: Tasks (then groups of tasks) whose unfinished sequences are filled together.
FAN_IN = 256
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, task long, piece long, class int, sequence_id long, offset long"


def harmonic_class(length: int, capacity: int) -> int:
    """The largest class j with j * length <= capacity."""
    j = capacity // length
    return j if j <= 32 else max(c for c in CLASSES if c <= j)


def cut_points(length: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of that many tokens, in order. Their sum is `length`."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        if j > 32 or capacity // j - rest <= SLACK * (capacity // j):
            pieces.append(rest)
            break
        pieces.append(capacity // (j + 1))
        rest -= pieces[-1]
    return pieces


def pack_documents(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int | None, capacity: int = 2048, added: Mapping[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document's ids (with end_id after them, unless None) lie in exactly one piece each; a sequence has at most
    `capacity` tokens and no gap between its pieces. A null or empty text is a document of no ids but end_id; without
    end_id it has no piece. The text of an added token becomes that token's id. Repeated rows and equal or null ids are packed as separate documents. Other columns of docs
    are left out. An empty table gives an empty result. Which sequence a piece lands in depends on how rows are dealt
    to tasks; the pieces' content doesn't.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file: bounded whatever the input
    end = b"" if end_id is None else struct.pack("<I", end_id)
    longs = ["doc_tokens", "task", "piece"]
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), *[(c, pa.int64()) for c in longs], ("class", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def pack(batches):
        from pyspark import TaskContext

        from tidemark.llm.vocabulary import library_ids

        task = TaskContext.get().partitionId()
        open_: dict[int, list] = defaultdict(list)
        piece = sequence = 0
        done: list[tuple] = []
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), library_ids(batch.column(1), ranks.value, pattern, added)):
                ids += end
                total, start = len(ids) // 4, 0
                for length in cut_points(total, capacity):
                    j = harmonic_class(length, capacity)
                    open_[j].append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total, task, piece, j))
                    start, piece = start + length, piece + 1
                    if len(open_[j]) == j:
                        offset = 0
                        for row in open_.pop(j):
                            done.append((*row, task << 32 | sequence, offset))
                            offset += row[2]
                        sequence += 1
            if done:
                yield record_batch(schema, [list(c) for c in zip(*done)])
                done = []
        left = [(*row, None, None) for rows in open_.values() for row in rows]
        if left:
            yield record_batch(schema, [list(c) for c in zip(*left)])

    pieces = written(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pack, _PIECES), "pieces")
    out = ["doc_id", "start", "length", "ids", "doc_tokens"]
    rest = pieces.where("sequence_id is null")
    placed = rest.join(_place(rest.select("task", "piece", "class", "length"), capacity), ["task", "piece"])
    return pieces.where("sequence_id is not null").select(*out, "sequence_id", "offset").unionByName(placed.select(*out, F.col("placed_in").alias("sequence_id"), F.col("at").alias("offset")))


def _place(rest: DataFrame, capacity: int) -> DataFrame:
    """(task, piece, placed_in, at) for the pieces of unfinished sequences."""
    tasks = (rest.agg(F.max("task")).first()[0] or 0) + 1
    columns = "task long, piece long, class int, length long, placed_in long, at long"

    def level_of(level: int):
        def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            j, block = int(key[0]), int(key[1])
            rows = rows.sort_values(["task", "piece"]).reset_index(drop=True)
            whole = len(rows) // j * j  # what is left over waits for the next level
            sequence = pd.Series(rows.index // j)
            at = rows.groupby(sequence)["length"].cumsum() - rows["length"]
            rows["placed_in"] = pd.array([(level << 60) + (block << 32) + (j << 20) + int(k) if i < whole else None for i, k in enumerate(sequence)], "Int64")
            rows["at"] = pd.array([int(x) if i < whole else None for i, x in enumerate(at)], "Int64")
            return rows[["task", "piece", "class", "length", "placed_in", "at"]]

        return fill

    def tail(rows: pd.DataFrame) -> pd.DataFrame:
        room: list[int] = []
        put = []
        for length in (rows := rows.sort_values(["length", "task", "piece"], ascending=[False, True, True]))["length"]:
            b = next((i for i, r in enumerate(room) if r >= length), len(room))
            if b == len(room):
                room.append(capacity)
            put.append((b, capacity - room[b]))
            room[b] -= length
        return rows.assign(placed_in=[(7 << 60) + b for b, _ in put], at=[at for _, at in put])[["task", "piece", "class", "length", "placed_in", "at"]]

    rest = rest.select("*", F.lit(None).cast("long").alias("placed_in"), F.lit(None).cast("long").alias("at"))
    level, found = 0, []
    while True:
        level, tasks = level + 1, -(-tasks // FAN_IN)
        width = FAN_IN**level
        step = written(rest.groupBy("class", F.expr(f"task div {width}").alias("block")).applyInPandas(level_of(level), columns), "filled")
        found.append(step.where("placed_in is not null"))
        rest = step.where("placed_in is null")
        if tasks == 1:
            break
    last = rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(tail, columns)  # fewer than j pieces of each class j
    for x in found:
        last = last.unionByName(x)
    return last.select("task", "piece", "placed_in", "at")
