"""Near-duplicate documents by Order MinHash.

Equal texts (word for word, whatever case and spacing) are one node first. A sketch of a text is a number of entries:
for each hash function the ENTRY shingles of least hash, each labelled with which occurrence of it it is, kept in text
order, so that equal entries mean shared shingles in the same order. Nodes with an entry in common stand in a bucket.
Pairs of a bucket are candidates if their sketches agree in AGREE entries and their lengths allow the similarity; only
then are their texts fetched and aligned over words. Classes are the connected components of what holds.

Which pairs of a bucket are tried is decided in steps, so that no bucket is expanded to all its pairs: each node with the
smallest of its buckets' smallest nodes; each bucket's smallest node with all others that aren't in one component with it
yet; then all pairs of small buckets that aren't in one component yet. What is left are pairs that agree in entries of large
buckets alone. As long as a large bucket holds several components, some of its nodes meet all nodes of the other components:
sixteen about, then 256 and so on up to all, so a large family is linked in a few rounds and no pair is left out for its
bucket's size. These meetings are no rows: a bucket goes to tasks in tiles of bounded size, which compare sketches and
word counts, align the pairs that both allow, and return links.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import Batch, mixed, word_hashes
from tidemark.llm.text_batches import record_batch, slices
from tidemark.operators.graph import connected_components
from tidemark.sources.scratch import release, written

#: Entries of a sketch, shingles of an entry, words of such a shingle: at similarity 0.8 evenly spread edits leave no run of
#: five words, but three in five of the pairs of words.
ENTRIES, ENTRY, GRAM = 32, 2, 2
#: Texts of fewer shingles have keys of one shingle as well.
SHORT = 16
#: Least similarity: 1 - edit distance over words / words of the longer text.
SIMILAR = 0.8
#: Entries that two sketches must have in common. At similarity 0.8, seven of 32 are expected.
AGREE = 2
#: Most members of a bucket that is expanded to all its pairs at once; larger ones go in tiles and rounds.
FEW = 32
#: About so many members of a bucket, of so many words together, are a tile; a task compares two tiles at a time.
TILE, TILE_WORDS = 1024, 1 << 20
#: Nodes of a large bucket that meet all others in the first round, and how many times more each round.
HUBS = 16
#: Cells of a text's word counts, a byte each, and up to which count a matrix product tells counts apart.
CELLS, TOLD = 256, 2
#: Orders of a pair's buckets by which one of them is chosen to align it.
ORDERS = 16
#: Ids up to this many are sent to the tasks that read texts.
FEW_NODES = 500_000


def sketch_keys(batch: Batch, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): each text with a word has a key for each entry; short ones have one more for each."""
    used = np.flatnonzero(batch.counts)
    if not len(used):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    labelled = mixed(batch.shingles + batch.occurrences().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 0)
    first = batch.first[used]
    lengths = batch.counts[used]
    keys, least_of = [], []
    for e in range(entries):
        h = mixed(labelled, e + 1)
        picks = []
        for _ in range(ENTRY):
            least = np.minimum.reduceat(h, first)
            # where the least stands: labelled shingles of a text are distinct, but for the top value that marks taken ones
            hit = np.flatnonzero(h == np.repeat(least, lengths))
            at = hit[np.searchsorted(hit, first)]
            picks.append((at, labelled[at]))
            h[at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        a, b = picks[0], picks[-1]
        least_of.append(mixed(a[1], 2 * entries + e + 1)[lengths < SHORT])
        before = a[0] <= b[0]
        left, right = np.where(before, a[1], b[1]), np.where(before, b[1], a[1])
        keys.append(mixed(left * np.uint64(3) ^ mixed(right, 7), e + 1))
    return np.concatenate([np.tile(used, entries), np.tile(used[lengths < SHORT], entries)]), np.concatenate(keys + least_of).view(np.int64)


def word_counts(batch: Batch) -> np.ndarray:
    """A row of CELLS bytes for each text: how many of its words fall in each cell, 255 for as many or more."""
    texts = len(batch.sizes)
    at = np.repeat(np.arange(texts), batch.sizes) * CELLS + (batch.words % np.uint64(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=texts * CELLS), 255).astype(np.uint8).reshape(texts, CELLS)


def counts_allow(x: np.ndarray, y: np.ndarray, longest: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of word counts allow texts of `longest` words to be `least` similar.

    An edit changes one word, so the distance is at least the longer text's words less those that both have. Two full cells
    prove nothing.
    """
    both = np.minimum(x, y)
    most = np.floor(longest * (1 - least) + 1e-9)
    return (both.sum(axis=1, dtype=np.int64) >= longest - most) | (both == 255).any(axis=1)


def common_at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x and each of y a bound from above of the words that both have, by one matrix product.

    Counts up to TOLD are one column for each step. What is above them adds at most the smaller text's sum of it.
    """
    (p, over_p), (q, over_q) = (
        (
            np.concatenate([c >= k + 1 for k in range(TOLD)], axis=1).astype(np.float32),
            np.where((c == 255).any(axis=1), np.inf, np.maximum(c.astype(np.float32) - TOLD, 0).sum(axis=1)),
        )
        for c in (x, y)
    )
    return p @ q.T + np.minimum(over_p[:, None], over_q[None])


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """1 - edit distance / longer length over words, if that is `least` or more; else some value below `least`.

    Equal runs at the ends and unique common shingles in between fix most of an alignment; its cost bounds the distance
    from above. Only where that doesn't settle it, the band that `least` allows is computed in full.
    """
    n, m = len(a), len(b)
    longest = max(n, m)
    if not longest:
        return 1.0
    most = int(longest * (1 - least) + 1e-9)
    if abs(n - m) > most:
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    lead = int(differ[0]) if len(differ) else short
    a, b = a[lead:], b[lead:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return 1 - max(len(a), len(b)) / longest
    values, counts_a = np.unique(a, return_counts=True)
    others, counts_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - np.minimum(counts_a[i], counts_b[j]).sum() > most:
        return 0.0
    if max(len(a), len(b)) - 1 - _common_pairs(a, b) > 2 * most:  # an edit changes two pairs of adjacent words
        return 0.0
    bound = _anchored_cost(a, b)
    if bound <= most:
        return 1 - bound / longest
    d = banded_distance(a, b, most)
    return 1 - d / longest if d <= most else 0.0


def _common_pairs(a: np.ndarray, b: np.ndarray) -> int:
    """How many pairs of adjacent words both have, each as often as in the text that has it less often."""
    x, y = (mixed(w[:-1], 1) ^ w[1:] for w in (a, b))
    values, counts_x = np.unique(x, return_counts=True)
    others, counts_y = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts_x[i], counts_y[j]).sum())


def _anchored_cost(a: np.ndarray, b: np.ndarray) -> int:
    """The cost of an alignment through the pairs of words that occur once in both, in order: at least the distance."""
    ua, ia, na = np.unique(a, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(b, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(ua[na == 1], ub[nb == 1], assume_unique=True, return_indices=True)
    x, y = ia[na == 1][i], ib[nb == 1][j]
    order = np.argsort(x)
    x, y = x[order], y[order]
    if len(y):  # those in order in both: a longest increasing run of y
        from bisect import bisect_left

        ends: list[int] = []
        last, back = [], []
        for k, v in enumerate(y.tolist()):
            p = bisect_left(ends, v)
            if p == len(ends):
                ends.append(v)
                last.append(k)
            else:
                ends[p], last[p] = v, k
            back.append(last[p - 1] if p else -1)
        keep, k = [], last[-1]
        while k >= 0:
            keep.append(k)
            k = back[k]
        x, y = x[keep[::-1]], y[keep[::-1]]
    x = np.concatenate([[-1], x, [len(a)]])
    y = np.concatenate([[-1], y, [len(b)]])
    cost = 0
    for p, q, r, s in zip(x[:-1] + 1, x[1:], y[:-1] + 1, y[1:]):
        u, v = q - p, s - r
        if u == v and u:
            cost += int((a[p:q] != b[r:s]).sum())
        else:
            cost += int(max(u, v))
    return cost


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance if it is at most `most`, else most + 1.

    The band's differences between neighbouring cells are the bits of whole numbers of 2 * most + 1 bits, one step a word
    of b (a published bit-parallel form of the recurrence). The distance is followed down the band's edge and then along
    the last row.
    """
    x, y = a.tolist(), b.tolist()
    if len(x) <= most:  # equal words in front change no distance and make room for the band
        x, y = [-1] * (most + 1) + x, [-1] * (most + 1) + y
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return most + 1
    places: dict[int, int] = {}
    for k, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << k
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down, d, row_bit = full ^ ((1 << most) - 1), 0, most, width - 2
    for i in range(m):
        begin = i - most
        same = places.get(y[i], 0)
        same = (same >> begin if begin >= 0 else same << -begin) & full
        level = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | (full & ~(level | up)), level & up
        if i < n - most:
            d += not level >> (width - 1)
            if d > 2 * most + m - n:
                return most + 1
        else:
            d += (right >> row_bit & 1) - (left >> row_bit & 1)
            row_bit -= 1
        up, down = left | (full & ~(level >> 1 | right)), level >> 1 & right
    return min(d, most + 1)


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, n_copies, kept: one row per row of docs.

    class_id is the smallest doc_id of the class, n_copies the rows of the class, kept whether the row is the class's
    first: doc_id = class_id. Texts without a word (null, empty, white space) and rows with a null id are in a class of
    their own. A repeated id with other text joins the classes of both texts. Very long texts are compared whole. Other
    columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    told = written(_sketches(rows), "sketches")
    worded = told.where("h is not null")
    kept = [F.min("doc_id").alias("node"), F.any_value("n_words").alias("n_words"), F.any_value("keys").alias("keys"), F.any_value("counts").alias("counts"), F.count("*").alias("copies")]
    nodes = written(worded.groupBy("h").agg(*kept), "texts")
    roots = _roots(_links(nodes, rows, least).union(_of_one_id(worded, nodes)))
    classes = nodes.select("h", "node", "copies").join(roots, "node", "left").select("h", "copies", F.coalesce("root", "node").alias("class_id"))
    sizes = written(classes.groupBy("class_id").agg(F.sum("copies").alias("n_copies")), "class-sizes")
    of_text = written(classes.select("h", "class_id").join(sizes, "class_id"), "classes")
    named = told.select("doc_id", "h").join(of_text, "h", "left")
    answered = named.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
    none = F.lit(None).cast("long")
    alone = docs.where(F.col(id_col).cast("long").isNull()).select(none.alias("doc_id"), none.alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return answered.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, keys, counts) of each row: h stands for the text's words in order and is null without one."""
    from xxhash import xxh3_128_digest

    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary()), ("n_words", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            texts = Batch(batch.column(1).to_pylist(), GRAM)
            which, keys = sketch_keys(texts)
            keys = keys[np.argsort(which, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=batch.num_rows))])
            h = [xxh3_128_digest(texts.words[a : a + n].tobytes()) if n else None for a, n in zip(texts.starts, texts.sizes)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int64()))
            counts = [row.tobytes() for row in word_counts(texts)]
            yield record_batch(schema, [batch.column(0), h, texts.sizes, listed, counts])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, h binary, n_words long, keys array<long>, counts binary")


def _of_one_id(worded: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes that an id stands for, if it stands for several."""
    several = worded.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("doc_id")
    texts = worded.join(several, "doc_id").join(nodes.select("h", "node"), "h").select("doc_id", "node")
    return texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).distinct()


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links, "a", "b").select("node", F.col("component").alias("root"))


def _links(nodes: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: pairs of nodes that hold, enough to have all components. The module's docstring has the steps."""
    keyed = nodes.select("node", "n_words", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1"), "shared-keys")
    members = written(keyed.join(shared, "key").select("key", "node", "n_words", "first", "size"), "bucket-members")
    release(rows.sparkSession)
    tried, links = [], []

    def attempt(pairs: DataFrame) -> None:
        """Adds those of (a, b) that hold and haven't been tried to `links`."""
        new = reduce(lambda p, t: p.join(t, ["a", "b"], "left_anti"), tried, pairs.where("a < b").distinct())
        tried.append(written(_agreeing(new, nodes, least), "pairs"))
        # texts of these pairs alone: most nodes share an entry with some other, few agree with one
        texts = written_texts(rows, tried[-1].select(F.explode(F.array("a", "b")).alias("node")).distinct())
        links.append(written(_similar(tried[-1], texts, least), "links"))
        release(rows.sparkSession)

    def rooted(of: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            named = roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            of = of.join(named, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return of

    # one try for each node first, so that a group of very many near copies doesn't link each of them in every bucket
    attempt(members.groupBy("node").agg(F.min("first").alias("a")).select("a", F.col("node").alias("b")))
    unlike = rooted(members, _roots(links[0]), "node", "first").where("root_node <> root_first")
    attempt(unlike.select(F.col("first").alias("a"), F.col("node").alias("b")))
    placed = rooted(members.where(f"size <= {FEW}"), _roots(links[0].union(links[1])), "node")
    small = written(placed.select("key", "node", "first", "root_node"), "small-buckets")
    both = small.select("key", F.col("node").alias("a"), F.col("root_node").alias("root_a"), "first").join(small.select("key", F.col("node").alias("b"), F.col("root_node").alias("root_b")), "key")
    attempt(both.where("a <> first and root_a <> root_b").select("a", "b"))

    # pairs that agree in entries of large buckets alone: in tiles, some nodes of each bucket with all others first. Small
    # buckets that a pair has in common have tried it, so these entries are all that such a pair may agree in
    large = members.where(f"size > {FEW}").groupBy("key", "node", "size").agg(F.max("n_words").alias("n_words"))
    tiles = large.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_words") / TILE_WORDS)).alias("tiles"))
    # a row a node with its buckets, at most a sketch's entries: roots and texts are joined to nodes, not to their buckets
    buckets = F.collect_list(F.struct("key", "size", "tiles")).alias("buckets")
    large = written(large.join(tiles, "key").groupBy("node").agg(buckets), "large-buckets")
    met, hubs, held, roots = 0, HUBS, None, _roots(reduce(DataFrame.union, links))
    while True:
        placed = rooted(large, roots, "node").select("node", "root_node", F.inline("buckets")).where(f"size > {met}")
        mixed_keys = written(_mixed(placed, "key", "root_node"), "mixed-buckets")
        most = mixed_keys.agg(F.max("size")).first()[0]
        if not most:
            break
        here = written(placed.join(mixed_keys.select("key"), "key").groupBy("node", "root_node").agg(buckets), "mixed-bucket-members")
        if held is None:  # buckets that are mixed later are so now
            listed = large.join(here.select("node"), "node", "left_semi").select("node", F.col("buckets.key").alias("keys"))
            held = nodes.select("node", "n_words", "counts").join(listed, "node").join(written_texts(rows, listed.select("node")), "node")
            held = written(held, "large-bucket-texts")
        links.append(written(_met(here.join(held, "node").select("*", F.inline("buckets")), hubs, least, met), "links"))
        release(rows.sparkSession)
        if hubs >= most:
            break
        if links[-1].limit(1).count():
            roots = _roots(reduce(DataFrame.union, links))
        met, hubs = hubs, hubs * HUBS
    return reduce(DataFrame.union, links)


def _met(members: DataFrame, hubs: int, least: float, met: int = 0) -> DataFrame:
    """(a, b), a < b: pairs of nodes of a bucket in two components whose lengths, sketches and word counts allow the
    similarity, of which one is among about `hubs` nodes of the bucket; all such pairs of a bucket of at most `hubs`.
    Pairs of which one is among its first `met` are left out.

    A bucket's nodes are dealt to tiles by hash. A task gets a tile of these `hubs` and a tile of all nodes, so no group
    grows with its bucket; a bucket whose nodes are all hubs has each two tiles once. Hash order chooses the hubs, so
    those of one bucket are those of others that hold the same nodes.

    If the members have texts, their keys are their buckets. The pairs are then aligned where they meet, each in one of
    the buckets that it has in common, and what is similar and links two components of the tile is returned.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    aligned = "text" in members.columns

    def compare(table: pa.Table) -> pa.Table:
        node, root, words, slot = (table[c].to_numpy() for c in ("node", "root_node", "n_words", "slot"))
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).reshape(-1, CELLS)
        has, names = _columns(table["keys"].combine_chunks())
        tile, size = table["tile"][0].as_py(), table["size"][0].as_py()
        as_hub, as_member = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("as_hub", "as_member"))
        # where two nodes meet twice, the lesser one is the hub
        twice = np.zeros(len(node), bool) if size <= hubs and tile["u"] != tile["t"] else slot < hubs
        x, y = np.flatnonzero(as_hub), np.flatnonzero(as_member)
        found = [np.zeros((2, 0), np.int64)]
        for i, j in ((x[a : a + TILE], y[b : b + TILE]) for a in range(0, len(x), TILE) for b in range(0, len(y), TILE)):
            long = np.maximum(words[i][:, None], words[j][None])
            near = np.minimum(words[i][:, None], words[j][None]) + 1e-6 >= least * long
            near &= (root[i][:, None] != root[j][None]) & (np.minimum(slot[i][:, None], slot[j][None]) >= met)
            near &= (node[i][:, None] < node[j][None]) | ~twice[j][None]
            near &= has[i].astype(np.float32) @ has[j].T.astype(np.float32) > AGREE - 0.5
            near &= common_at_most(counts[i], counts[j]) + 1e-3 >= least * long
            p, q = np.nonzero(near)
            for s in range(0, len(p), 1 << 14):
                u, v = i[p[s : s + (1 << 14)]], j[q[s : s + (1 << 14)]]
                if aligned:
                    here = _chosen(has[u] & has[v], names, node[u] ^ node[v]) == tile["key"]
                    u, v = u[here], v[here]
                good = counts_allow(counts[u], counts[v], np.maximum(words[u], words[v]), least)
                found.append(np.stack([u[good], v[good]]))
        i, j = np.concatenate(found, axis=1)
        if aligned:
            i, j = _linking(table["text"], root, i, j, least)
        pairs = np.unique(np.sort(np.stack([node[i], node[j]]), axis=0), axis=1)
        return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

    whole = f"size <= {hubs}"
    dealt = members if "tiles" in members.columns else members.withColumn("tiles", F.ceil(F.col("size") / TILE))
    dealt = dealt.withColumn("hub_tiles", F.expr(f"ceil(tiles * least({hubs} / size, 1D))")).withColumn("spot", F.xxhash64("node", F.lit("tile")))
    dealt = dealt.withColumn("tile", F.expr("pmod(spot, tiles)")).withColumn("slot", F.expr("cast(floor(shiftrightunsigned(xxhash64(node), 11) / 9007199254740992D * size) as long)"))
    dealt = dealt.withColumn("hub_tile", F.expr(f"if({whole}, tile, pmod(spot, hub_tiles))")).withColumn("is_hub", F.expr(f"slot < {hubs}"))
    as_member = F.expr(f"transform(sequence(0L, if({whole}, tile, hub_tiles - 1)), t -> struct(t as u, tile as t, true as as_member, is_hub and t = hub_tile as as_hub))")
    as_hub = F.expr(f"if(is_hub, transform(filter(sequence(if({whole}, tile, 0L), tiles - 1), t -> t <> tile), t -> struct(hub_tile as u, t as t, false as as_member, true as as_hub)), array())")
    carried = ["node", "root_node", "n_words", "keys", "counts", "size", "slot", *(["text"] if aligned else [])]
    sent = dealt.select("key", *carried, F.inline(F.concat(as_member, as_hub)))
    # grouped by one value: by its parts, the join's partitions by key would do, and a bucket's tiles would be one task's
    tiles = sent.select(F.struct("key", "u", "t").alias("tile"), *carried, "as_member", "as_hub")
    return tiles.groupBy("tile").applyInArrow(compare, "a long, b long")


def _columns(keys: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys each row has, a column for each key that two rows have, and these keys."""
    row, flat = np.asarray(pa.compute.list_parent_indices(keys)), np.asarray(pa.compute.list_flatten(keys))
    names, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    has = np.zeros((len(keys), len(names)), bool)
    has[row, at] = True
    return has[:, n > 1], names[n > 1]


def _chosen(common: np.ndarray, names: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """For each row of `common`, one of the names that it marks: whatever else stands in the table, the same for a pair."""
    if not common.shape[1]:
        return np.zeros(len(common), np.int64)
    order = (mixed(pair.view(np.uint64), 3) % np.uint64(ORDERS)).astype(np.int64)
    out = np.zeros(len(common), np.int64)
    for k in np.unique(order):
        of = np.flatnonzero(order == k)
        by = np.argsort(mixed(names.view(np.uint64), 100 + int(k)), kind="stable")
        out[of] = names[by[np.argmax(common[of][:, by], axis=1)]]
    return out


def _linking(texts: pa.ChunkedArray, root: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of texts that are similar; pairs whose components others link first are left out."""
    used = np.unique(np.concatenate([i, j]))
    words = dict(zip(used.tolist(), map(word_hashes, texts.take(pa.array(used)).to_pylist())))
    root, links = root.copy(), []
    for n, (u, v) in enumerate(zip(i.tolist(), j.tolist())):
        if root[u] != root[v] and edit_similarity(words[u], words[v], least) >= least:
            root[root == root[v]] = root[u]
            links.append(n)
    return i[links], j[links]


def sketch_rows(keys: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each sketch, an entry a column, those of one shingle last; and whether the sketch has the latter."""
    rows, short = np.zeros((len(keys), 2 * ENTRIES), np.int64), np.array([len(k) > ENTRIES for k in keys], bool)
    for row, k in zip(rows, keys):
        row[: len(k)] = k
    return rows, short


def entries_in_common(x: np.ndarray, y: np.ndarray, short: np.ndarray) -> np.ndarray:
    """How many entries each row of x and the same row of y have in common; those of one shingle count if both have them."""
    same = x == y
    return same[:, :ENTRIES].sum(axis=1) + np.where(short, same[:, ENTRIES:].sum(axis=1), 0)


def _mixed(members: DataFrame, key: str, root: str) -> DataFrame:
    """(key, size) of the buckets whose members aren't in one component."""
    counts = members.groupBy(key).agg(F.count("*").alias("size"), F.min(root).alias("lo"), F.max(root).alias("hi"))
    return counts.where("lo <> hi").select(key, "size")


def _agreeing(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose lengths allow the similarity and whose sketches have AGREE entries in common."""
    of_a, of_b = (nodes.select(F.col("node").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}")) for c in "ab")
    like = f"n_a + 1e-6 >= {least} * n_b and n_b + 1e-6 >= {least} * n_a"
    return pairs.join(of_a, "a").join(of_b, "b").where(like).where(F.size(F.array_intersect("keys_a", "keys_b")) >= AGREE).select("a", "b").distinct()


def texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), each distinct text of a node once."""
    held = rows.where("text is not null").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return held.groupBy("doc_id", F.xxhash64("text").alias("t")).agg(F.any_value("text").alias("text")).select(F.col("doc_id").alias("node"), "text")


def written_texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """texts_of, written. Up to FEW_NODES ids (their number is checked) go to the tasks that read the texts, so that only
    the texts that are wanted are shuffled."""
    nodes = written(nodes, "candidates")
    if nodes.limit(FEW_NODES + 1).count() <= FEW_NODES:
        rows = rows.join(F.broadcast(nodes.withColumnRenamed("node", "doc_id")), "doc_id", "left_semi")
    return written(texts_of(rows, nodes), "candidate-texts")


def _similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            hashed = {t: word_hashes(t) for t in {*x, *y}}
            good = [k for k in range(len(a)) if edit_similarity(hashed[x[k]], hashed[y[k]], least) >= least]
            yield record_batch(schema, [[a[k] for k in good], [b[k] for k in good]])

    x, y = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
