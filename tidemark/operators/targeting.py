"""Targeting channels against inventory keys and each other, by bitmaps of channels filed under attribute values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.sources.scratch import written

#: Channels of one index, and the value combinations that are looked up in it at once.
CHANNELS, LOOKUPS = 4096, 2048
#: Pairs of a batch that a task gives.
PAIRS = 1 << 18


class ChannelIndex:
    """A bitmap of channels for each value of each attribute: those that list the value, or restrict nothing.

    A null list fits nothing. Row 0 of an attribute's bitmaps is for values that no channel lists, null among them.
    """

    def __init__(self, lists: Sequence[pa.Array]):
        self.channels = len(lists[0])
        words = -(-self.channels // 64)
        self.values, self.bitmaps, self.listed = [], [], []
        for each in lists:
            flat, of = pc.list_flatten(each), pc.list_parent_indices(each).to_numpy()
            value_set = pc.drop_null(pc.unique(flat))
            code = pc.fill_null(pc.index_in(flat, value_set=value_set), -1).to_numpy()
            bits = np.zeros((len(value_set) + 1, words), np.uint64)
            known, size = code >= 0, pc.fill_null(pc.list_value_length(each), -1).to_numpy()
            np.bitwise_or.at(bits, (code[known] + 1, of[known] // 64), self._bit(of[known]))
            free, there = np.flatnonzero(size == 0), np.flatnonzero(size >= 0)
            bits |= self._bitmap(free, words)
            self.values.append(value_set)
            self.bitmaps.append(bits)
            self.listed.append(self._bitmap(there, words))

    @staticmethod
    def _bit(channel: np.ndarray) -> np.ndarray:
        return np.uint64(1) << (channel % 64).astype(np.uint64)

    def _bitmap(self, channels: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words, np.uint64)
        np.bitwise_or.at(out, channels // 64, self._bit(channels))
        return out

    def fitting(self, lists: Sequence[pa.Array]) -> np.ndarray:
        """Whether each row fits each channel: on every attribute, a value of the row's list does, or that list is empty."""
        found = None
        for each, values, bitmaps, listed in zip(lists, self.values, self.bitmaps, self.listed):
            flat = pc.list_flatten(each)
            code = pc.fill_null(pc.index_in(flat.cast(values.type), value_set=values), -1).to_numpy() + 1
            size = pc.fill_null(pc.list_value_length(each), -1).to_numpy()
            bits = np.zeros((len(each), len(listed)), np.uint64)
            bits[size == 0] = listed
            full = np.flatnonzero(size > 0)
            if len(full):
                bits[full] = np.bitwise_or.reduceat(bitmaps[code], np.cumsum(size[full]) - size[full])
            found = bits if found is None else found & bits
        return np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : self.channels].astype(bool)


def _indexed(channels: DataFrame) -> tuple[DataFrame, int]:
    """(block, channels): all channels in blocks of about CHANNELS, and the number of blocks."""
    blocks = -(-channels.count() // CHANNELS) or 1
    dealt = written(channels.repartition(blocks).withColumn("block", F.spark_partition_id().cast("long")), "channels")
    return dealt.groupBy("block").agg(F.collect_list(F.struct(*channels.columns)).alias("channels")), blocks


def _pairs(rows: DataFrame, key: Sequence[str], channels: DataFrame, attributes: Sequence[str], all_pairs: bool = False) -> DataFrame:
    """The columns of `rows` named by key, and those of `channels`, for each row that fits a channel.

    rows are distinct; both have array columns named `attributes`. all_pairs: every row with every channel, and `fits`.
    Rows go in chunks; every chunk meets every block of channels under a key of their own, so no key is hot. Each such
    meeting is a few machine words a row and attribute for 64 channels at once, and gives batches of bounded size.
    """
    blocks, n_blocks = _indexed(channels)
    chunks = -(-rows.count() // LOOKUPS) or 1
    chunked = rows.groupBy(F.pmod(F.xxhash64(*key), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    meetings = chunked.withColumn("block", number(n_blocks)).join(blocks.withColumn("chunk", number(chunks)), ["chunk", "block"]).select("rows", "channels")
    named = channels.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, channels in zip(batch["rows"], batch["channels"]):
                rows, channels = (pa.RecordBatch.from_struct_array(x.values) for x in (rows, channels))
                index = ChannelIndex([channels[a] for a in attributes])
                step = max(1, PAIRS // channels.num_rows)
                for start in range(0, rows.num_rows, step):
                    some = rows.slice(start, step)
                    fits = index.fitting([some[a] for a in attributes])
                    i, j = np.nonzero(np.ones_like(fits) if all_pairs else fits)
                    columns = [some[k].take(pa.array(i)) for k in key] + [channels[c].take(pa.array(j)) for c in named]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(fits.ravel())] if all_pairs else columns, names=[*key, *named, *["fits"] * all_pairs])

    fields = [*[rows.schema[k] for k in key], *channels.schema.fields, *[StructField("fits", BooleanType())] * all_pairs]
    return meetings.mapInArrow(run, StructType(fields))


def match_channels(channels: DataFrame, inventory: DataFrame, attributes: Sequence[str], how: str = "inner") -> DataFrame:
    """Every inventory row with every channel that it fits: the channel's columns, its lists named tc_<attribute>.

    how: inner, or left to keep inventory rows that fit none. A row fits if each of the channel's lists is empty or has
    the row's value; a null value fits empty lists only, and a null list fits no row. The distinct combinations of values
    that the inventory has are looked up in bitmaps of channels; inventory rows are then joined by their combination.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    named = channels.select(*[F.col(c).alias(f"tc_{c}") if c in attributes else F.col(c) for c in channels.columns])
    keys = [f"_k{n}" for n in range(len(attributes))]
    combinations = written(inventory.select(*[F.col(a).alias(k) for a, k in zip(attributes, keys)]).distinct(), "combinations")
    rows = combinations.select(*keys, *[F.array(k).alias(f"tc_{a}") for a, k in zip(attributes, keys)])
    found = _pairs(rows, keys, named, [f"tc_{a}" for a in attributes])
    same = [inventory[a].eqNullSafe(found[k]) for a, k in zip(attributes, keys)]
    return inventory.join(found, same, how).drop(*keys)


def intersecting(channels: DataFrame, id_col: str, attributes: Sequence[str]) -> DataFrame:
    """(a_id, b_id, meets) for all a_id < b_id: whether on each attribute one of the lists is empty or they share a value.

    All pairs are the result; ids are distinct. A null list meets nothing.
    """
    rows = channels.select(F.col(id_col).alias("a_id"), *attributes)
    found = _pairs(rows, ["a_id"], channels.select(F.col(id_col).alias("b_id"), *attributes), attributes, all_pairs=True)
    return found.where("a_id < b_id").select("a_id", "b_id", F.col("fits").alias("meets"))
