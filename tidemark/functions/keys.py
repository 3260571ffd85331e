"""Columns over composite keys, buckets and text at the edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(key: Column, i: int) -> Column:
    """The i-th component (from 0) of a comma-joined key, '' if there is none."""
    return F.coalesce(F.try_element_at(F.split(key, ","), F.lit(i + 1)), F.lit(""))


def joined_key(*parts: Column) -> Column:
    """Components joined by commas. A null component would shift the others, so it counts as ''."""
    return F.concat_ws(",", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def blank_part(key: Column, i: int) -> Column:
    """The key with component i emptied, as many commas as before."""
    return F.array_join(F.transform(F.split(key, ",", -1), lambda x, j: F.when(j == i, F.lit("")).otherwise(x)), ",")


def drop_part(key: Column, i: int) -> Column:
    return F.array_join(F.filter(F.split(key, ",", -1), lambda x, j: j != i), ",")


def replace_part(key: Column, i: int, value: Column) -> Column:
    return F.array_join(F.transform(F.split(key, ",", -1), lambda x, j: F.when(j == i, value).otherwise(x)), ",")


def sha256_bucket(value: Column, n: int) -> Column:
    """The 256-bit hash of a string modulo n (below 2**31), folded over eight 32-bit digits."""
    digit = lambda i: F.conv(F.substring(F.sha2(value, 256), 8 * i + 1, 8), 16, 10).cast("long")
    rest = F.lit(0).cast("long")
    for i in range(8):
        rest = (rest * F.lit(1 << 32) + digit(i)) % n
    return rest.cast("int")


def matched_index(value: Column, index: Mapping[str, int], otherwise: int) -> Column:
    """when-chain from values to numbers."""
    out = F.lit(otherwise)
    for k, v in index.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def query_key(lists: Sequence[Column], price_model: Column) -> Column:
    """A canonical key: each list lower-cased, trimmed, joined by '-'; lists joined by '|'; CPC counts as CPM."""
    flat = [F.array_join(F.transform(x, lambda v: F.lower(F.trim(v))), "-") for x in lists]
    return F.concat_ws("|", *flat, F.when(F.upper(price_model).isin("CPC", "CPM"), F.lit("CPM")).otherwise(F.upper(price_model)))


def sanitized(text: Column) -> Column:
    """Without quotes, line breaks and character entities; lower case, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"&[a-zA-Z]+;|&#[0-9]+;|[\"'\r\n]", "")))
