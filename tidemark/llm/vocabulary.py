"""Byte-level BPE vocabularies in rank files, and encoding by a library."""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Mapping

import pyarrow as pa


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def read_added(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file: text -> id. They are found in a text before it is cut in words."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take part of their surroundings aren't supported")
    return {t["content"]: t["id"] for t in added}


_READY: dict = {}


def library_ids(texts: pa.Array, ranks: dict[bytes, int], pattern: str, added: Mapping[str, int] | None = None) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers. Null is empty.

    Where an added token's text stands it becomes that token; without added tokens all is plain text. The library's
    encoder is built once in a Python worker and kept for its later tasks.
    """
    import tiktoken

    added = dict(added or {})
    key = (pattern, len(ranks), hash(frozenset(ranks.items())), tuple(added.items()))
    if key not in _READY:
        _READY.clear()
        _READY[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    encoding = _READY[key]

    def ids(text: str) -> bytes:
        plain = not any(t in text for t in added)
        return array("I", encoding.encode_ordinary(text) if plain else encoding.encode(text, allowed_special="all")).tobytes()

    return [ids(t) if t else b"" for t in texts.to_pylist()]
