"""Fill-in-middle: a text's units in three parts, the middle one moved to the end, as whole Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_batches import record_batch, slices_of_bytes

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(seed: int, id_col: Column) -> list[Column]:
    """Four numbers below 2**32 from seed and id: groups of eight hex digits of SHA-256 of `seed:id`. A null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units, parents, ordinals): every line with its line break, flat; which text it is of; and its number there."""
    lists = pc.split_pattern(texts, "\n")
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    last = np.ones(len(flat), bool)
    last[:-1] = parents[1:] != parents[:-1]
    units = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", "\n"), "")
    full = ~last | (pc.binary_length(units).to_numpy() > 0)  # nothing follows a text's last line break
    units, parents = units.filter(pa.array(full)), parents[full]
    counts = np.bincount(parents, minlength=len(texts))
    return units, parents, np.arange(len(parents)) - (np.cumsum(counts) - counts)[parents]


def joined_where(units: pa.Array, parents: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """For each of n texts, its chosen units joined."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[chosen], minlength=n))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units.filter(pa.array(chosen))), "")


def fill_in_middle(
    docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text; n is its number of lines.

    The prefix ends after the smaller of two drawn numbers of units, the middle after the larger. form psm puts prefix,
    suffix and middle behind their markers, spm suffix, prefix and middle. A text stays plain (null for both lengths) if
    it is empty or null, if it holds a marker, or if it isn't drawn (percent). Draws depend on seed and id only, so rows
    of one id draw alike; a null id draws as an empty one. Lengths are in code points. Parts may be empty. Extra columns
    are ignored; an empty table gives an empty result. A task works on slices of bounded bytes, or on one text.
    """
    made = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(batches, "text"):
            texts, size = batch["text"], batch.num_rows
            h = [batch[f"h{k}"].to_numpy() for k in range(1, 5)]
            units, parents, ordinals = units_of(texts)
            n = np.bincount(parents, minlength=size)
            ends = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
            role = (ordinals >= ends[0][parents]).astype(int) + (ordinals >= ends[1][parents])
            prefix, middle, suffix = (joined_where(units, parents, role == k, size) for k in range(3))
            plain = pc.equal(texts, "").to_numpy(zero_copy_only=False) | (h[2] % 100 >= percent)
            for m in markers:
                plain |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
            plain, spm = pa.array(plain), pa.array(h[3] % 100 < spm_percent)
            p, s, m = markers
            first = pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, ""), pc.binary_join_element_wise(p, prefix, s, suffix, ""))
            output = pc.if_else(plain, texts, pc.binary_join_element_wise(first, m, middle, ""))
            form = pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            yield record_batch(pa.schema([batch.schema.field("id"), *made]), [batch["id"], n, form, *chars, output])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *draws(seed, F.col(id_col)))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(transformed: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """transformed with `restored`: the text that output and form say. Columns besides these two are passed on."""
    pattern = "|".join(map(re.escape, markers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(batches, "output"):
            form = batch["form"]
            moved = pc.not_equal(form, PLAIN)
            parts = pc.list_flatten(pc.split_pattern_regex(batch["output"].filter(moved), pattern))  # nothing and three parts of each
            first, second, middle = (parts.take(pa.array(np.arange(k, len(parts), 4))) for k in (1, 2, 3))
            spm = pc.equal(form.filter(moved), SPM)
            whole = pc.binary_join_element_wise(pc.if_else(spm, second, first), middle, pc.if_else(spm, first, second), "")
            restored = pc.replace_with_mask(batch["output"], moved, whole)
            yield pa.RecordBatch.from_arrays([*batch.columns, restored], names=[*batch.schema.names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    return transformed.mapInArrow(run, f"{fields}, restored string")
