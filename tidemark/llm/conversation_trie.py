"""The prefix trie of conversations: one row a distinct opening, with counts over the conversations that begin with it.

Every conversation's prefixes get digests by running sums, so a long conversation isn't one task's work. Equal digests
are counted before the shuffle; they are the trie's nodes, each owned by its smallest member. Nodes one below the other
with the same members are one run. Runs of small subtrees go to shards, where each gets a slot of a minimal perfect
hash; counts lie in flat arrays by slot and are added up along the parents' slots, the deepest first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.hot_join import join_one
from tidemark.llm.shingles import mixed
from tidemark.operators.indexing import running_sum
from tidemark.sources.scratch import written

#: Conversations up to which a subtree stays in one shard. Nodes with more are at most one in so many of all turns; they
#: are the last shard.
MEMBERS = 2000
#: Runs of a shard, about. One subtree has fewer than two a member.
SHARD_RUNS = 20_000
#: Rows of a long conversation or run that meet their one partner under one key.
CHUNK = 4096


#: What is known of a run: owner and members, depths, digests above and at its foot, tokens before it, sums.
RUN = pa.schema([(c, pa.int64()) for c in ("owner", "n", "top", "pa", "pb", "last", "a", "b", "before", "saved", "leaves")])


class SlotTable:
    """A slot in [0, n) for each of n distinct 128-bit keys, one to one: a minimal perfect hash by levels.

    On each level, keys that are alone in their cell settle there, numbered in order of cells; the others go on to the
    next level. The key that has a slot is stored in it, so a key that isn't in the table is told by comparing.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.levels: list[np.ndarray] = []
        self.slots, settled, left = np.empty(len(a), np.int64), 0, np.arange(len(a))
        while len(left):
            cells = self._cells(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(cells, minlength=2 * len(left)) == 1
            slot = np.where(alone, settled + np.cumsum(alone) - 1, -1)
            self.levels.append(slot)
            self.slots[left] = slot[cells]
            settled, left = settled + int(alone.sum()), left[slot[cells] < 0]
        self.a[self.slots], self.b[self.slots] = a, b

    @staticmethod
    def _cells(a: np.ndarray, b: np.ndarray, level: int, cells: int) -> np.ndarray:
        return ((mixed(a, 2 * level) + mixed(b, 2 * level + 1)) % np.uint64(cells)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for keys that aren't in the table."""
        a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, slot in enumerate(self.levels):
            out[left] = slot[self._cells(a[left], b[left], level, len(slot))]
            left = left[out[left] < 0]
        same = out >= 0
        same[same] = (self.a[out[same]] == a[same]) & (self.b[out[same]] == b[same])
        return np.where(same, out, -1)


def read_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, content, tokens): turns numbered from 1 in order of turn (null first), each with the SHA-256 of its
    role and text and its text's UTF-8 bytes.

    Null role and text are empty. Turns of equal number stand in order of content. Rows of null conv_id are of no
    conversation and go. Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), content.alias("content"), F.octet_length(text).cast("long").alias("tokens"), F.lit(1).alias("one")
    )
    numbered = running_sum(turns, ["conv_id"], ["turn", "content"], "one", "at")
    return written(numbered.select("conv_id", "at", "content", "tokens"), "turns")


def share_openings(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): each conversation c begins with the first h turns of c - c % every (all if it has fewer, none if
    there's no such conversation) and goes on with its own after its first h; h = crc32(c in decimal) % most.

    % has the sign of c, as in SQL. ids has every conversation, also those that are left without turns.
    """
    c = F.col("conv_id")
    ids = written(
        turns.groupBy("conv_id").agg(F.max("at").alias("length")).select("conv_id", "length", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h")), "conversations"
    )
    lengths = ids.select(F.col("conv_id").alias("base"), F.col("length").alias("of_base"))
    both = ids.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    opening = turns.where(F.col("at") < most).withColumnRenamed("conv_id", "base").join(both.select("base", "conv_id", "h"), "base").where("at <= h")
    placed = both.select("conv_id", "h", "taken", F.explode(F.expr(f"sequence(0, length div {CHUNK})")).alias("chunk"))
    own = turns.withColumn("chunk", F.expr(f"at div {CHUNK}")).join(placed, ["conv_id", "chunk"]).where("at > h").withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "at", "content", "tokens"]
    return opening.select(*columns).union(own.select(*columns)), ids.select("conv_id")


def _prefixes(turns: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """A row for each prefix of each conversation, the empty one too: its digest (a, b), that of the prefix before it
    (pa, pb), what the last turn is checked by, and the tokens up to it.

    A digest is the exclusive or of hashes of the turns with their places. Like the tokens, it is summed in ranges of
    rows, and what stands before a range comes from one row a conversation and range.
    """
    hashes = [F.xxhash64(F.lit(2 * seed + k), "at", "content").alias(f"e{k}") for k in range(2)]
    rows = turns.select("conv_id", "at", "tokens", F.xxhash64("content").alias("turn"), *hashes)
    dealt = written(rows.repartitionByRange("conv_id", "at").withColumn("_p", F.spark_partition_id()), "ranges")
    sums = {"e0": F.bit_xor, "e1": F.bit_xor, "tokens": F.sum}
    earlier = Window.partitionBy("conv_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    upto = Window.partitionBy("_p", "conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("_p", "conv_id").agg(*[f(c).alias(c) for c, f in sums.items()])
    before = parts.select("_p", "conv_id", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c, f in sums.items()])
    within = dealt.select("*", *[f(c).over(upto).alias(f"upto_{c}") for c, f in sums.items()])
    a, b = (F.col(f"upto_e{k}").bitwiseXOR(F.col(f"before_e{k}")) for k in range(2))
    found = within.join(before, ["_p", "conv_id"]).select(
        "conv_id", "at", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("e0")).alias("pa"), b.bitwiseXOR(F.col("e1")).alias("pb"), "turn", "tokens",
        (F.col("upto_tokens") + F.col("before_tokens")).alias("upto"),
    )
    zero = F.lit(0).cast("long")
    root = ids.select("conv_id", zero.alias("at"), zero.alias("a"), zero.alias("b"), *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb", "turn")], zero.alias("tokens"), zero.alias("upto"))
    return written(found.withColumn("at", F.col("at").cast("long")).unionByName(root), "prefixes")


def _nodes(prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """The distinct prefixes with their members' number and the smallest of them; whether no digest stands for two."""
    checked = ("pa", "pb", "turn")
    grouped = prefixes.groupBy("a", "b", "at").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("owner"), F.max("tokens").alias("tokens"), F.max("upto").alias("upto"), *[f(c).alias(f"{x}_{c}") for c in checked for x, f in (("lo", F.min), ("hi", F.max))]
    )
    differs = F.lit(False)
    for c in checked:
        differs = differs | (F.col(f"lo_{c}") != F.col(f"hi_{c}"))
    nodes = written(grouped.select("a", "b", "at", "n", "owner", "tokens", "upto", F.col("lo_pa").alias("pa"), F.col("lo_pb").alias("pb"), F.coalesce(differs, F.lit(False)).alias("differs")), "nodes")
    return nodes.drop("differs"), not nodes.where("differs").limit(1).count()


def _summed(rows: pa.Table) -> pa.Table:
    """Runs of one shard with saved and leaves summed over their subtrees."""
    value = {c: rows[c].fill_null(0).to_numpy() for c in ("a", "b", "pa", "pb", "top", "saved", "leaves")}
    table = SlotTable(value["a"], value["b"])
    sums = {c: np.zeros(len(rows), np.int64) for c in ("saved", "leaves")}
    parent, depth = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
    for c, into in sums.items():
        np.add.at(into, table.slots, value[c])
    depth[table.slots] = value["top"]
    below = rows["pa"].is_valid().to_numpy()
    parent[table.slots[below]] = table.find(value["pa"][below], value["pb"][below])
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        for into in sums.values():
            np.add.at(into, parent[level], into[level])
    found = {**{c: rows[c] for c in RUN.names}, **{c: into[table.slots] for c, into in sums.items()}, "highest": parent[table.slots] < 0}
    return pa.table({c: found[c] for c in (*RUN.names, "highest")}, pa.schema([*RUN, ("highest", pa.bool_())]))


def _subtree_sums(prefixes: DataFrame, nodes: DataFrame, ids: DataFrame, members: int, shard_runs: int) -> DataFrame:
    """(owner, n, first, last, before, saved, leaves) of every run: its depths, the tokens before it, and the sums over
    the subtree of its highest node. A node's children are counted in `nodes`.

    A run's members all go on to its next node, so it is told by its owner and their number, and there are fewer than
    two runs a conversation. Subtrees of at most `members` conversations are dealt to shards whole. What they add up
    to is summed for each node above them, and those nodes are the last shard.
    """
    runs = written(
        nodes.groupBy("owner", "n").agg(
            F.min(F.struct("at", "pa", "pb")).alias("head"), F.max(F.struct("at", "a", "b", "children")).alias("foot"), F.max("upto").alias("upto"), F.min(F.col("upto") - F.col("tokens")).alias("before")
        ).select(
            "owner", "n", F.col("head.at").alias("top"), "head.pa", "head.pb", F.col("foot.at").alias("last"), "foot.a", "foot.b", "before", ((F.col("n") - 1) * (F.col("upto") - F.col("before"))).alias("saved"),
            (F.col("foot.children") == 0).cast("long").alias("leaves"),
        ), "runs",
    )
    large = written(nodes.where(F.col("n") > members).select("a", "b", "n"), "large-nodes")
    deepest = join_one(prefixes.select("conv_id", "at", "a", "b"), large, ["a", "b"], "n", prefixes.count()).groupBy("conv_id").agg(F.max("at").alias("deepest"))
    next_at = ids.join(deepest, "conv_id", "left").select("conv_id", (F.coalesce("deepest", F.lit(-1)) + 1).alias("at"))
    tops = prefixes.join(next_at, ["conv_id", "at"]).select(F.col("conv_id").alias("owner"), F.col("a").alias("ta"), F.col("b").alias("tb"))

    light = runs.where(F.col("n") <= members)
    shards = -(-light.count() // shard_runs) or 1
    fields = ", ".join(f"{c} long" for c in RUN.names) + ", highest boolean"
    dealt = light.join(tops, "owner").withColumn("shard", F.pmod(F.xxhash64("ta", "tb"), F.lit(shards))).drop("ta", "tb")
    summed = written(dealt.groupBy("shard").applyInArrow(_summed, fields), "summed-runs")

    given = summed.where("highest and pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
    above = runs.where(F.col("n") > members).join(given, ["a", "b"], "left")
    above = above.withColumns({"saved": F.col("saved") + F.coalesce("more", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0))}).drop("more", "more_leaves")
    last = above.withColumn("shard", F.lit(0)).groupBy("shard").applyInArrow(_summed, fields)
    return summed.unionByName(last).select("owner", "n", "top", "last", "before", "saved", "leaves")


def _ends(prefixes: DataFrame) -> DataFrame:
    """(a, b, ends): SHA-256 of the ids of the conversations that end at a node, in order, joined by commas.

    Ids are joined by the few hundred that share a range first; a node's ranges are then hashed one after another as
    they come, sorted, so the ids of a hot node are never in memory at once.
    """
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("at", "a", "b")).alias("p")).select("conv_id", "p.a", "p.b")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = last.groupBy("a", "b", F.expr("conv_id div 512").alias("range")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for a, b, text in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ids"].to_pylist()):
                if (a, b) == node:
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (a, b), sha256()
                digest.update(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends"), d)) for d in done], schema)
        if node:
            yield pa.RecordBatch.from_pylist([{"a": node[0], "b": node[1], "ends": digest.hexdigest()}], schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())])
    return ranges.repartition("a", "b").sortWithinPartitions("a", "b", "range").select("a", "b", "ids").mapInArrow(run, "a long, b long, ends string")


def prefix_trie(turns: DataFrame, ids: DataFrame, members: int = MEMBERS, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, at, content, tokens), at being 1, 2, ... in each conversation; ids: every conv_id once, those
    without turns too. Conversations that agree on their first d turns share the node of depth d; all share the root.
    conv_id and depth name a node. saved_tokens: over the node's subtree, what all members but one repeat of the last
    turn. n_leaves: nodes of the subtree without children. ends_sha256: of the members that end here. Without
    conversations there's no node. Should two prefixes get one digest, which the parents' digests and a third hash of
    the turns tell, all is done again with other hashes.
    """
    turns = written(turns, "rebuilt-turns")
    for seed in count():
        prefixes = _prefixes(turns, ids, seed)
        nodes, distinct = _nodes(prefixes)
        if distinct:
            break
    children = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("children"))
    nodes = written(nodes.join(children, ["a", "b"], "left").withColumn("children", F.coalesce("children", F.lit(0))), "nodes")
    sums = _subtree_sums(prefixes, nodes, ids, members, shard_runs)

    # a node's parent has the same owner, but for the highest node of each owner
    highest = written(nodes.where("pa is not null").groupBy("owner").agg(F.min(F.struct("at", "pa", "pb")).alias("p")).select("owner", "p.at", F.col("p.pa").alias("a"), F.col("p.pb").alias("b")), "highest")
    parents = join_one(highest, nodes.where("children > 0").select("a", "b", "children", F.col("owner").alias("parent")), ["a", "b"], "children", nodes.count())
    ranges = sums.where("n > 1").withColumn("chunk", F.explode(F.expr(f"sequence(top div {CHUNK}, last div {CHUNK})"))).drop("top", "last")
    found = nodes.join(_ends(prefixes), ["a", "b"], "left").join(parents.select("owner", "at", "parent"), ["owner", "at"], "left")
    found = found.withColumn("chunk", F.expr(f"at div {CHUNK}")).join(ranges, ["owner", "n", "chunk"], "left")
    above = (F.col("n") - 1) * (F.col("upto") - F.col("tokens") - F.col("before"))
    return found.select(
        F.col("owner").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") > 0, F.coalesce("parent", "owner")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(F.col("saved") - above, F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
