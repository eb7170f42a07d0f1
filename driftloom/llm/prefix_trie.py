"""Prefix tries of sequences, built as Patricia trees from sorted order.

Distinct sequences are sorted over all partitions. Within a partition a stack follows neighbours' common
prefixes and makes only points: where sequences branch, where one ends, and leaves; the stretch from a point
to the one above it is a compressed edge. Counts and sums are taken on these points. Nodes inside an edge have
one child and the members of the point below, so they are made last, from suffix sums along the edge.

What two neighbouring partitions share is the common prefix of the last sequence of one and the first of the
next: one number for each border. Points of a partition along that prefix are kept uncompressed and carry
partial counts, of which a shared node's own is counted by the first partition that holds it; the few shared
points are then merged by an aggregation. No partition or driver sees a whole trie.

A sequence is one row: 16 bytes (an MD5 digest of role and text) and a length for each element. Equal sequences
are made one before sorting; the digest of the ids that end at a node streams over sorted rows, so a group of
copies of any size is never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import written

#: Bytes of one element in a key, and distinct sequences of one sorted partition.
WIDE, EACH = 16, 20_000
NODES = "_node binary, _above binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, _ends string, _tails array<long>"


def common(a: bytes, b: bytes) -> int:
    """How many elements two keys share from their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDE
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // WIDE


def names(key: bytes, deepest: int) -> list[bytes]:
    """Digests of the first 0, 1, ... deepest elements of a key."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for d in range(deepest):
        h.update(key[d * WIDE : (d + 1) * WIDE])
        out.append(h.copy().digest())
    return out


class Point:
    """An open point: aggregates of its subtree so far, and the element lengths of the edge above it (the point's own last)."""

    __slots__ = ("name", "depth", "edge", "first", "members", "children", "leaves", "weighed", "plain", "ends", "shared", "owned")

    def __init__(self, name: bytes, depth: int, edge: np.ndarray, shared: bool, owned: bool) -> None:
        self.name, self.depth, self.edge, self.shared, self.owned = name, depth, edge, shared, owned
        self.first, self.members, self.children, self.leaves, self.weighed, self.plain, self.ends = None, 0, 0, 0, 0, 0, None


class Patricia:
    """The points of one partition's sorted sequences. before, after: elements shared with the partitions on both sides; -1 where there is none."""

    def __init__(self, before: int, after: int) -> None:
        self.before, self.after = before, after
        self.stack: list[Point] = []
        self.key, self.out, self.border = None, [], None

    def push(self, depth: int, edge: np.ndarray, name: bytes, leftmost: bool = False) -> Point:
        shared = leftmost and depth <= self.before
        point = Point(name, depth, edge, shared, not shared)
        self.stack.append(point)
        return point

    def cut(self, depth: int) -> None:
        """Closes the points below this depth; a branch point is made at it if there is none."""
        while self.stack[-1].depth > depth:
            low = self.stack.pop()
            if self.stack[-1].depth < depth:
                n = depth - self.stack[-1].depth
                name = self.border[depth] if self.border else hashlib.blake2b(self.key[: depth * WIDE], digest_size=16).digest()
                self.push(depth, low.edge[:n], name)
                low.edge = low.edge[n:]
            self.close(low, self.stack[-1])

    def close(self, p: Point, above: Point | None) -> None:
        own = int(p.edge[-1]) if len(p.edge) else 0
        p.weighed += p.members * own
        p.plain += own if p.owned else 0
        inner = p.edge[:-1]
        if above is not None:
            above.first = p.first if above.first is None else min(above.first, p.first)
            above.members += p.members
            above.children += p.owned or len(inner) > 0
            above.leaves += p.leaves
            total = int(inner.sum())
            above.weighed += p.weighed + p.members * total
            above.plain += p.plain + total
        tails = np.r_[np.cumsum(inner[::-1])[::-1], 0]
        shared = p.shared or p.depth <= self.after and self.border is not None
        self.out.append((shared, p.name, above.name if above is not None else None, p.depth, p.first, p.members, int(p.children), p.leaves, p.weighed - p.plain, p.ends, tails))

    def add(self, key: bytes, lengths: np.ndarray, members: int, first: int, ends: str) -> None:
        """The next sequence; keys come in ascending order, all different."""
        n = len(key) // WIDE
        if self.key is None:
            shared = names(key, max(self.before, 0))
            for d, name in enumerate(shared):
                self.push(d, lengths[d - 1 : d] if d else lengths[:0], name, leftmost=True)
        else:
            self.settle(common(self.key, key))
        if self.stack[-1].depth < n:
            self.push(n, lengths[self.stack[-1].depth :], hashlib.blake2b(key, digest_size=16).digest())
        top = self.stack[-1]
        top.members, top.first, top.ends = members, first, ends
        self.key = key

    def settle(self, shares: int) -> None:
        """Says whether the last sequence is a leaf, then closes what the next one doesn't share."""
        if shares < self.stack[-1].depth:
            self.stack[-1].leaves += 1
        self.cut(max(shares, 0))

    def finish(self) -> None:
        if self.key is None:
            return
        self.settle(self.after)
        self.border = names(self.key, max(self.after, 0))
        for depth in range(max(self.after, 0) - 1, -1, -1):
            self.cut(depth)
        self.close(self.stack.pop(), None)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def ended(rows: DataFrame) -> DataFrame:
    """_of, _members, _first, _ends of rows (_of binary, _id long): how many ids a sequence has, the smallest, and SHA-256 of all in ascending order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> tuple:
            return of, members, first, h.hexdigest()

        of, out = None, []
        for b in batches:
            for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != of:
                    if of is not None:
                        out.append(row())
                    of, members, first, h = key, 0, i, hashlib.sha256()
                h.update(b"%d" % i if not members else b",%d" % i)
                members += 1
            yield batch(out)
            out = []
        if of is not None:
            yield batch([row()])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["_of", "_members", "_first", "_ends"])

    return rows.select("_of", "_id").repartition("_of").sortWithinPartitions("_of", "_id").mapInArrow(run, "_of binary, _members long, _first long, _ends string")


def borders(sorted_keys: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition (_part) of sorted keys, the elements shared with the one before and the one after; two numbers a partition reach the driver."""
    ends = sorted_keys.groupBy("_part").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    beside = ends.select("_part", "_low", F.lag("_high").over(Window.orderBy("_part")).alias("_prior"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, low, prior = (b.column(k).to_pylist() for k in range(3))
            shares = [-1 if p is None else common(p, x) for p, x in zip(prior, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(shares, pa.int64())], ["_part", "_shares"])

    found = sorted((r._part, r._shares) for r in beside.mapInArrow(run, "_part int, _shares long").collect())
    return {part: (shares, found[k + 1][1] if k + 1 < len(found) else -1) for k, (part, shares) in enumerate(found)}


def points(rows: DataFrame, each: int = EACH) -> DataFrame:
    """NODES of rows (_id long, _key binary, _lengths array<long>): the points of the Patricia tree of all keys."""
    rows = rows.withColumn("_of", F.unhex(F.md5("_key")))
    distinct = rows.select("_of", "_key", "_lengths").dropDuplicates(["_of"])
    sequences = distinct.join(ended(rows), "_of")
    staged = written(sequences)
    parts = max(1, -(-staged.count() // each))
    order = written(staged.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id()))
    edges = borders(order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part = None, None
        for b in batches:
            lengths = b.column(2)
            values, offsets = lengths.values.to_numpy(), lengths.offsets.to_numpy()
            of, keys, members, first, ends = (b.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            done: list[tuple] = []
            for k in range(len(of)):
                if of[k] != part:
                    if tree:
                        tree.finish()
                        done += tree.taken()
                    part, tree = of[k], Patricia(*edges[of[k]])
                # a copy, so that open points don't hold whole batches
                tree.add(keys[k], values[offsets[k] : offsets[k + 1]].copy(), members[k], first[k], ends[k])
                done += tree.taken()
            yield batch(done)
        if tree:
            tree.finish()
            yield batch(tree.taken())

    def batch(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 11
        kinds = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], shape)

    shape = ["_shared", *(x.split()[0] for x in NODES.split(", "))]
    placed = order.repartitionByRange(parts, "_part").sortWithinPartitions("_part", "_key")
    found = written(placed.select("_part", "_key", "_lengths", "_members", "_first", "_ends").mapInArrow(run, "_shared boolean, " + NODES))
    merged = (
        found.where("_shared").groupBy("_node").agg(
            F.max("_above").alias("_above"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("_ends").alias("_ends"), F.max("_tails").alias("_tails"),
        )
    )
    return found.where("NOT _shared").drop("_shared").unionByName(merged)


def trie(sequences: DataFrame, each: int = EACH) -> DataFrame:
    """Every node of the prefix trie of sequences (conv_id long, items array<struct<digest: string, n: long>>).

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes of the subtree), saved_tokens ((n_convs - 1) * n summed over the subtree), ends_sha256 (of the ids that end
    here). digest: 32 hexadecimal digits that name an element. Sequences without elements end at the root. A null
    conv_id takes no part; each other one must come once. No sequences make no nodes.
    """
    items = F.coalesce("items", F.array().cast("array<struct<digest: string, n: bigint>>"))
    rows = sequences.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("_id"),
        F.unhex(F.array_join(F.transform(items, lambda x: x["digest"]), "")).alias("_key"),
        F.transform(items, lambda x: x["n"].cast("long")).alias("_lengths"),
    )
    tree = written(points(written(rows), each))
    above = tree.select(F.col("_node").alias("_above"), F.col("conv_id").alias("_above_conv"))
    every = tree.join(above, "_above", "left").select("*", F.posexplode("_tails").alias("_j", "_tail"))
    last = F.col("_j") == F.size("_tails") - 1
    return every.select(
        "conv_id",
        (F.col("depth") - F.size("_tails") + 1 + F.col("_j")).cast("long").alias("depth"),
        F.when(F.col("_j") == 0, F.col("_above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("_tail")).alias("saved_tokens"),
        F.when(last & F.col("_ends").isNotNull(), F.col("_ends")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, items (struct digest, n) of each conversation's turns, by turn with null first; equal turns by their digests.

    A null role or text counts as empty; rows without a conversation take no part. n: code points of the text.
    Texts become digests before anything is shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("n")).alias("_turn"))
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return found.select("conv_id", F.transform("_turns", lambda t: F.struct(t["digest"].alias("digest"), t["n"].alias("n"))).alias("items"))


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Conversations (conv_id, items) that begin with the first h turns of the first of their family; h = crc32(conv_id) % most. An absent one gives none."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_family"), F.slice("items", 1, most - 1).alias("_heads"))
    own = turns.withColumn("_family", F.col("conv_id") - F.col("conv_id") % family).withColumn("_h", h)
    kept = F.slice(F.coalesce("_heads", F.array().cast(turns.schema["items"].dataType)), F.lit(1), F.col("_h"))
    rest = F.slice("items", F.col("_h") + 1, F.size("items"))
    return own.join(heads, "_family", "left").select("conv_id", F.concat(kept, rest).alias("items"))
