"""Byte-level BPE: a minimal perfect hash over the vocabulary, and merges by a heap over linked bytes.

The pre-token pattern never joins a space that stands between two non-space characters to what precedes it, so a text
may be cut before each such space and the cuts encoded alone. A batch's cuts repeat, so its distinct cuts are encoded
once and the batch's ids gathered from them. A text with a cut that is empty or begins or ends in white space (runs of
spaces, a space beside a line break) is encoded in one go instead.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_batches import Recent, record_batch, slices
from tidemark.llm.vocabulary import read_ranks

_SHIFT = 20  # ids are below 2**20


def mixed(hashed: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    """Another 64-bit hash for each displacement d."""
    x = (hashed ^ np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """bytes -> slot in [0, n), one to one on the n keys it was built from (hash, displace).

    Keys fall in buckets by one hash. The largest buckets first, each bucket gets the first displacement that sends all
    its keys to free slots; a lone key is sent to a slot that is left, kept as a negative displacement. Other keys reach
    some slot too, so a caller compares the key that is stored there.
    """

    def __init__(self, keys: list[bytes]):
        from xxhash import xxh3_64_intdigest as h

        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        hashed = np.fromiter(map(h, keys), np.uint64, n)
        members: dict[int, list[int]] = {}
        for i, b in enumerate((hashed % np.uint64(self.buckets)).tolist()):
            members.setdefault(b, []).append(i)
        self.displace, self.slot_of = np.zeros(self.buckets, np.int64), [0] * n
        free, left, tries = np.ones(n, bool), n - 1, np.arange(64)
        for bucket, own in sorted(members.items(), key=lambda m: -len(m[1])):
            if len(own) == 1:
                while not free[left]:
                    left -= 1
                d, slots = -left - 1, [left]
            else:
                for first in range(0, 64 * n, 64):
                    tried = (mixed(hashed[own][None, :], tries[:, None] + first) % np.uint64(n)).astype(np.int64)
                    fits = free[tried].all(1)
                    d, slots = next(((first + k, row) for k in np.flatnonzero(fits) if len(set(row := tried[k].tolist())) == len(own)), (None, None))
                    if slots:
                        break
                else:
                    raise ValueError("two keys have one hash")
            self.displace[bucket] = d
            for i, s in zip(own, slots):
                free[s], self.slot_of[i] = False, s

    def slots(self, hashed: np.ndarray) -> np.ndarray:
        d = self.displace[(hashed % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -d - 1, (mixed(hashed, d) % np.uint64(self.n)).astype(np.int64))


class BytePairs:
    """Encoding and decoding by a rank table that has every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys, self.ids = [b""] * len(keys), [0] * len(keys)
        for k, s in zip(keys, self.hash.slot_of):
            self.keys[s], self.ids[s] = k, ranks[k]
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {ranks[k[:i]] << _SHIFT | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self.bytes_of = {r: k for k, r in ranks.items()}

    def whole(self, pieces: list[bytes]) -> np.ndarray:
        """The ids of the pre-tokens that are in the vocabulary as they stand, -1 for the others."""
        from xxhash import xxh3_64_intdigest as h

        slots = self.hash.slots(np.fromiter(map(h, pieces), np.uint64, len(pieces))).tolist()
        keys, ids = self.keys, self.ids
        return np.array([ids[s] if keys[s] == p else -1 for s, p in zip(slots, pieces)], np.int64)

    def merged(self, piece: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until none is left: O(n log n) for n bytes."""
        single, pairs, n = self.single, self.pairs, len(piece)
        ids = [single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pairs.get(ids[i] << _SHIFT | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << _SHIFT | ids[j]) != r:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(r << _SHIFT | ids[k])) is not None:
                    heappush(heap, x << 32 | i)
            h = before[i]
            if h >= 0 and (x := pairs.get(ids[h] << _SHIFT | r)) is not None:
                heappush(heap, x << 32 | h)
        return [x for x in ids if x >= 0]

    def pieces(self, pieces: list[str], memo: dict) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces one after another, and the count of each."""
        raw = [p.encode() for p in pieces]
        one = self.whole(raw)
        many = np.flatnonzero(one < 0)
        merged = [memo[raw[i]] for i in many]
        count = np.ones(len(raw), np.int64)
        count[many] = [len(m) for m in merged]
        ids = np.repeat(one, count)
        ids[ids < 0] = [i for m in merged for i in m]
        return ids, count


def gathered(source: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """source[starts[i] : starts[i] + counts[i]] for all i, one after another."""
    ends = np.cumsum(counts)
    return source[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class BatchEncoder:
    """Texts -> ids, over encode_text(str) -> ids and encode_cuts(list of cuts with their space) -> (ids, count of each)."""

    def __init__(self, encode_text: Callable[[str], list[int]], encode_cuts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_text, self.encode_cuts = encode_text, encode_cuts

    def counts_and_ids(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Per text the number of ids, and the ids as little-endian unsigned 32-bit integers. Null is empty."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.int64), []
        parts = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        at = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        at -= at[0]
        coded = parts.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = coded.dictionary.to_pylist()
        odd = np.fromiter((not c or c[0].isspace() or c[-1].isspace() for c in cuts), bool, len(cuts))
        sound = np.flatnonzero(~odd)
        ids, own = self.encode_cuts([" " + cuts[i] for i in sound])
        count, start = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        count[sound], start[sound] = own, np.cumsum(own) - own
        first = at[:-1]  # a text's first cut has no space before it
        whole = np.add.reduceat(odd[which], first) > 0
        heads = [self.encode_text(t if w else cuts[which[a]]) for t, w, a in zip(texts.to_pylist(), whole, first)] if whole.any() else [self.encode_text(cuts[which[a]]) if cuts[which[a]] else [] for a in first]
        heads = [h if len(h) else [] for h in heads]
        c, s = count[which], start[which]
        c[np.repeat(whole, np.diff(at))] = 0
        c[first] = [len(h) for h in heads]
        s[first] = len(ids) + np.cumsum(c[first]) - c[first]
        counts = np.add.reduceat(c, first)
        flat = [i for h in heads for i in h]
        out = gathered(np.concatenate([ids.astype("<u4"), np.array(flat, "<u4")]), s, c).tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return counts, [out[a:b] for a, b in zip([0, *ends[:-1]], ends)]


_READY: dict = {}


def _codec(ranks: dict[bytes, int], pattern: str) -> tuple[BytePairs, BatchEncoder]:
    """Built once in a Python worker and kept for its later tasks, memo included."""
    import regex

    key = (pattern, len(ranks), hash(frozenset(ranks.items())))
    if key not in _READY:
        pairs = BytePairs(ranks)
        split, memo = regex.compile(pattern).findall, Recent(pairs.merged, 200_000)

        def cuts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = pa.array(split("".join(texts)), pa.string()).dictionary_encode()
            words = found.dictionary.to_pylist()
            ids, count = pairs.pieces(words, memo)
            which = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            opens = np.fromiter((w[0] == " " for w in words), bool, len(words))[which]  # a cut's only space is its first character
            counts = count[which]
            at = np.flatnonzero(opens)
            return gathered(ids, (np.cumsum(count) - count)[which], counts), np.add.reduceat(counts, at) if len(at) else counts[:0]

        def text(t: str) -> list[int]:
            return pairs.pieces(split(t), memo)[0].tolist() if t else []

        _READY.clear()
        _READY[key] = pairs, BatchEncoder(text, cuts)
    return _READY[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, decoded (bytes, from those ids) for every row.

    A null or empty text has no ids and decodes to no bytes. Rows with equal or null ids stay apart; other columns are
    left out. Any text of valid UTF-8 comes back whole. A pre-token of m bytes that isn't in the vocabulary costs
    O(m log m), so a text of one long run is no special case.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file: bounded whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        from tidemark.llm.bpe import _codec

        pairs, encoder = _codec(ranks.value, pattern)
        bytes_of = pairs.bytes_of.__getitem__
        for batch in slices(batches, 1024):
            counts, ids = encoder.counts_and_ids(batch.column(1))
            decoded = [b"".join(map(bytes_of, np.frombuffer(x, "<u4").tolist())) for x in ids]
            yield record_batch(schema, [batch.column(0), counts, ids, decoded])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
