"""Prefix trie of rebuilt conversations, family by family.

A family is the conversations of one base id (conv_id - conv_id % 100).  Its turns go to one task in order, the base
conversation first; there every member is rebuilt (the first h turns of the base, then its own after its first h) and
the family's small trie is built of 128-bit digests: no text is held or shuffled, and a family needs memory for its
nodes only.  Then only the combined nodes of families meet.  A node that one family alone has lies, with its whole
subtree, in that family, so its figures are final.  Nodes that families share form the top of the trie; their
children, leaves and savings are summed by doubling distances: each node carries the keys of its ancestors 1, 2, 4, ...
above, so a trie of depth d takes log2(d) rounds over the shared nodes, each a sum by key and a join of unique keys.

The ids that end at a shared node are hashed in order by a task that streams them, a string for each 10,000 ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.scratch import shared_if_small, stored

FAMILY, HEADS = 100, 6
ROOT = bytes(16)
NODE_SCHEMA = "base long, key binary, anc array<binary>, depth long, conv_id long, parent_conv_id long, n_convs long, chars long, n_children long, n_leaves long, saved_tokens long, ends string, ends_sha256 string"
_ARROW = pa.schema([("base", pa.int64()), ("key", pa.binary()), ("anc", pa.list_(pa.binary())), *[(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "chars", "n_children", "n_leaves", "saved_tokens")], ("ends", pa.string()), ("ends_sha256", pa.string())])
#: Conversation ids in one string of the ends of a shared node.
ENDS_SPAN = 10_000


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, base, the columns that order a conversation's turns, and each turn's digest and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    conv = F.col("conv_id").cast("long")
    rows = conversations.filter(conv.isNotNull()).select(conv.alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)


class _Family:
    """The trie of one family: node i has the columns at place i; a child stands after its parent."""

    def __init__(self, base: int) -> None:
        self.base, self.head, self.child = base, [], {}
        self.key, self.parent, self.depth, self.conv, self.n, self.chars, self.ends = [ROOT], [-1], [0], [None], [0], [0], [[]]

    def start(self, conv: int) -> None:
        self.now, self.at, self.own, self.h = conv, 0, 0, zlib.crc32(str(conv).encode()) % HEADS
        self._visit(0)
        if conv != self.base:
            for digest, chars in self.head[: self.h]:
                self._step(digest, chars)

    def turn(self, digest: bytes, chars: int) -> None:
        if self.now == self.base and len(self.head) < HEADS:
            self.head.append((digest, chars))
        if self.now == self.base or self.own >= self.h:
            self._step(digest, chars)
        self.own += 1

    def end(self) -> None:
        self.ends[self.at].append(self.now)

    def _visit(self, node: int) -> None:
        self.n[node] += 1
        self.conv[node] = self.now if self.conv[node] is None else min(self.conv[node], self.now)

    def _step(self, digest: bytes, chars: int) -> None:
        node = self.child.get((self.at, digest))
        if node is None:
            node = self.child[self.at, digest] = len(self.key)
            self.key.append(hashlib.sha256(self.key[self.at] + digest).digest()[:16])
            self.parent.append(self.at)
            self.depth.append(self.depth[self.at] + 1)
            self.conv.append(None)
            self.n.append(0)
            self.chars.append(chars)
            self.ends.append([])
        self.at = node
        self._visit(node)

    def above(self) -> list[list[int]]:
        """For each node its ancestors 1, 2, 4, ... above."""
        out: list[list[int]] = []
        for node, up in enumerate(self.parent):
            own = [up] if node else []
            while own and len(own) <= len(out[own[-1]]):
                own.append(out[own[-1]][len(own) - 1])
            out.append(own)
        return out

    def batches(self, rows: int = 1000) -> Iterator[pa.RecordBatch]:
        size = len(self.key)
        children, leaves, saved = [0] * size, [0] * size, [(n - 1) * c for n, c in zip(self.n, self.chars)]
        for node in range(size - 1, -1, -1):
            leaves[node] = leaves[node] or 1
            if node:
                up = self.parent[node]
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        above = self.above()
        ends = [",".join(map(str, sorted(x))) for x in self.ends]
        for lo in range(0, size, rows):
            of = range(lo, min(size, lo + rows))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([
                [self.base] * len(of), [self.key[i] for i in of], [[self.key[a] for a in above[i]] for i in of], [self.depth[i] for i in of], [self.conv[i] for i in of],
                [self.conv[self.parent[i]] if i else None for i in of], [self.n[i] for i in of], [self.chars[i] for i in of], [children[i] for i in of], [leaves[i] for i in of],
                [saved[i] for i in of], [ends[i] for i in of], [hashlib.sha256(ends[i].encode()).hexdigest() for i in of],
            ], _ARROW)], schema=_ARROW)


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family's trie; figures are the family's own."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, conv = None, None
        for batch in batches:
            for base, c, digest, chars in zip(*(x.to_pylist() for x in batch.columns)):
                if family is None or family.base != base:
                    if family is not None:
                        family.end()
                        yield from family.batches()
                    family, conv = _Family(base), None
                if conv != c:
                    if conv is not None:
                        family.end()
                    conv = c
                    family.start(c)
                family.turn(digest, chars)
        if family is not None:
            family.end()
            yield from family.batches()

    rows = turns(conversations)
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "head", "digest"]
    return rows.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "digest", "chars").mapInArrow(build, NODE_SCHEMA)


def ends_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of rows (key, base, ends): the strings of a key in order of base, comma-joined and hashed as a stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        row = lambda: pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])
        for batch in batches:
            for key, text in zip(*(x.to_pylist() for x in batch.columns)):
                if key != now:
                    if state is not None:
                        yield row()
                    now, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state is not None:
            yield row()

    span = F.floor(F.col("base") / ENDS_SPAN)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda x: x["ends"]), ",")
    blocks = ends.groupBy("key", span.alias("span")).agg(joined.alias("ends"))  # at most 100 families in a group
    return blocks.repartition("key").sortWithinPartitions("key", "span").select("key", "ends").mapInArrow(digest, "key binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """key and, for each value, its sum over the node's subtree; nodes(key, anc, values) closed under ancestors."""
    now = stored(nodes.select("key", "anc", *values), "trie-sums")
    rounds = now.agg(F.max(F.size("anc"))).first()[0] or 0
    for k in range(rounds):
        below = now.filter(F.size("anc") > k).groupBy(F.col("anc")[k].alias("key")).agg(*[F.sum(v).alias(f"__{v}") for v in values])
        now = stored(now.join(below, "key", "left").select("key", "anc", *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]), "trie-sums")
    return now.select("key", *values)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role and text are empty; a null turn comes first; turns of one number go by role, the text's first 64
    characters, then the digest of both.  Rows without a conv_id belong to no conversation.  A repeated row is one
    more turn.  The remainder of a negative id has its sign, as in SQL.  Other columns are not read.  An empty table
    has no nodes, not even a root.  A conversation, however long, is read by one task; what a family keeps are nodes.
    """
    nodes = stored(family_nodes(conversations), "family-nodes")
    first = lambda c: F.any_value(c).alias(c)
    merged = stored(nodes.groupBy("key").agg(
        F.count("*").alias("families"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), first("depth"), first("chars"), first("anc"), first("parent_conv_id"), first("n_children"), first("n_leaves"), first("saved_tokens"), first("ends_sha256"),
    ), "merged-nodes")
    own, shared = merged.filter("families = 1"), merged.filter("families > 1").select("key", "anc", "depth", "conv_id", "n_convs", "chars")
    up = F.col("anc")[0]
    tops = merged.filter(F.size("anc") > 0).groupBy(up.alias("key")).agg(F.count("*").alias("n_children"), *[F.sum(F.when(F.col("families") == 1, F.col(c))).alias(f"own_{c}") for c in ("n_leaves", "saved_tokens")])
    counted = stored(shared.join(tops, "key", "left").select(
        "key", "anc", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(F.coalesce("own_n_leaves", F.lit(0))).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("own_saved_tokens", F.lit(0))).alias("saved_tokens"),
    ), "shared-nodes")
    sums = subtree_sums(counted, ["n_leaves", "saved_tokens"])
    keys = shared_if_small(counted.select("key"), 24)
    ends = ends_digests(nodes.filter("ends != ''").select("key", "base", "ends").join(keys, "key", "left_semi"))
    whole = counted.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["anc", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = own.select(*columns).unionByName(whole.select(*columns)).withColumn("__up", F.try_element_at("anc", F.lit(1))).drop("anc")
    parents = shared_if_small(counted.select(F.col("key").alias("__key"), F.col("conv_id").alias("__parent")), 32)
    return every.join(parents, F.col("__up") == F.col("__key"), "left").withColumn("parent_conv_id", F.coalesce("__parent", "parent_conv_id")).select(*columns[1:])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
