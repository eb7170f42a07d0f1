"""Exact dedup through a cuckoo-filter index of live digests.

Texts are equal when they are identical after every space, tab, line feed, vertical tab, form feed
and carriage return is deleted. A digest is the SHA-256 of what remains, in UTF-8.

The index is dealt over shards by digest. A shard holds a cuckoo filter (16-bit fingerprints, four
to a bucket) and, by bucket, the stored digests with what is known of each. A filter miss proves
that a digest is new; a hit is verified against the stored digests of its two buckets, so false
positives change nothing. When an insertion finds no free slot after ``KICKS`` evictions the filter
doubles and is rebuilt from the stored digests. Deletion removes the digest and one equal
fingerprint. Every input partition first merges its own copies through a small index, so that a
group of copies sends a row for each partition at most and no key gathers in one task.

Null text counts as empty. Rows with equal texts: the row with the most code points in its original
text stays, then the smallest doc_id (null last). doc_id names a text: fully repeated rows count in
group_size and share one value of kept, and ``drop_exact_copies`` leaves one of them. An empty table
gives no rows. Extra columns are never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import SPACES, as_bytes, free, numbers, written

#: Digests that one shard of the index holds, about.
SHARD_KEYS = 200_000
#: Digests that one input partition merges before it passes them on.
LOCAL_KEYS = 100_000


class CuckooIndex:
    """Live digests (bytes) with a value for each: insert, find, delete; resizes itself."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64) -> None:
        self.random = random.Random(7)
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.slots: list[list[int]] = [[] for _ in range(self.buckets)]
        self.stored: dict[int, dict[bytes, object]] = {}
        self.size = 0

    def print_of(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def home(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & (self.buckets - 1)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def find(self, digest: bytes) -> object | None:
        """The stored value, None if the digest isn't live."""
        mark, at = self.print_of(digest), self.home(digest)
        if mark in self.slots[at] or mark in self.slots[self.other(at, mark)]:
            return self.stored.get(at, {}).get(digest)  # content is bucketed by home
        return None

    def put(self, digest: bytes, value: object) -> None:
        """Inserts the digest, or replaces the value of a live one. A filter miss spares the look into the stored content."""
        mark, at = self.print_of(digest), self.home(digest)
        hit = mark in self.slots[at] or mark in self.slots[self.other(at, mark)]
        fresh = not hit or digest not in self.stored.get(at, ())
        self.stored.setdefault(at, {})[digest] = value
        if fresh:
            self.size += 1
            if not self.place(at, mark):
                self.resize()

    def delete(self, digest: bytes) -> bool:
        """Removes a live digest; False if it isn't one."""
        mark, at = self.print_of(digest), self.home(digest)
        content = self.stored.get(at, {})
        if digest not in content:
            return False
        del content[digest]
        self.size -= 1
        for bucket in (at, self.other(at, mark)):
            if mark in self.slots[bucket]:
                self.slots[bucket].remove(mark)
                return True
        raise AssertionError("a live digest has a fingerprint")

    def place(self, at: int, mark: int) -> bool:
        for bucket in (at, self.other(at, mark)):
            if len(self.slots[bucket]) < self.SLOTS:
                self.slots[bucket].append(mark)
                return True
        for _ in range(self.KICKS):
            k = self.random.randrange(self.SLOTS)
            self.slots[at][k], mark = mark, self.slots[at][k]
            at = self.other(at, mark)
            if len(self.slots[at]) < self.SLOTS:
                self.slots[at].append(mark)
                return True
        return False

    def resize(self) -> None:
        """Twice the buckets, filled again from the stored digests."""
        items = list(self.items())
        placed = False
        while not placed:
            self.buckets *= 2
            self.slots, self.stored = [[] for _ in range(self.buckets)], {}
            placed = True
            for digest, value in items:
                at = self.home(digest)
                self.stored.setdefault(at, {})[digest] = value
                placed = placed and self.place(at, self.print_of(digest))

    def items(self) -> Iterator[tuple[bytes, object]]:
        for content in self.stored.values():
            yield from content.items()


def digest_of(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(None, SPACES)).digest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _sha (binary), _points (code points of the original text) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            points = [len(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest_of(t) for t in texts], pa.binary()), pa.array(points, pa.int64())], ["_id", "_sha", "_points"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "_id long, _sha binary, _points long")


def merged(index: CuckooIndex, digest: bytes, copies: int, points: int, doc: int | None) -> None:
    """Adds copies of a digest; the best row so far is its value's end."""
    rank = (-points, doc is None, doc or 0)
    value = index.find(digest)
    index.put(digest, (copies, rank) if value is None else (value[0] + copies, min(value[1], rank)))


def merging(limit: int | None):
    """A mapInArrow function that merges rows of (_sha, _copies, _points, _id); passes on what it has at ``limit`` digests."""

    def out(index: CuckooIndex) -> pa.RecordBatch:
        items = list(index.items())
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in items], pa.binary()), pa.array([v[0] for _, v in items], pa.int64()), pa.array([-v[1][0] for _, v in items], pa.int64()), pa.array([None if v[1][1] else v[1][2] for _, v in items], pa.int64())],
            ["_sha", "_copies", "_points", "_id"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for b in batches:
            for sha, copies, points, doc in zip(*(b.column(c).to_pylist() for c in ("_sha", "_copies", "_points", "_id")), strict=True):
                merged(index, sha, copies, points, doc)
            if limit and index.size >= limit:
                yield out(index)
                index = CuckooIndex()
        yield out(index)

    return run


SHAPE = "_sha binary, _copies long, _points long, _id long"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(digest of each row, one row of the index for each live digest: _sha, _copies, _points and _id of the row that stays)."""
    rows = written(digests(docs, id_col, text_col))
    local = rows.withColumn("_copies", F.lit(1).cast("long")).mapInArrow(merging(LOCAL_KEYS), SHAPE)
    shards = numbers(docs.sparkSession, rows.count(), SHARD_KEYS)
    return rows, local.repartition(shards, "_sha").mapInArrow(merging(None), SHAPE)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. See the module's text for nulls and ties."""
    rows, index = exact_groups(docs, id_col, text_col)
    index = index.select(F.col("_sha"), F.col("_copies"), F.col("_id").alias("_keep"), F.col("_points").alias("_most"))
    found = rows.join(index, "_sha")
    best = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_points") == F.col("_most"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_copies").alias("group_size"), best.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of fully equal ids and lengths in a group, one row."""
    rows, index = exact_groups(docs, id_col, text_col)
    long, keep, most, nth = free(docs, "_long", "_keep", "_most", "_nth")
    best = index.select(F.col("_id").alias(keep), F.col("_points").alias(most))
    marked = docs.select("*", F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias(long))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.col(long) == F.col(most))
    kept = marked.join(best, same, "left_semi")
    twice = rows.groupBy("_id", "_sha", "_points").count().where("count > 1").limit(1).count()
    if twice:  # repeated rows: only one of each stays
        one = Window.partitionBy(F.col(id_col), F.sha2(F.col(text_col).cast("string"), 256)).orderBy(F.col(long))
        kept = kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1)
    return kept.select(docs.columns)


def sharded(digests_: DataFrame, shards: int) -> DataFrame:
    return digests_.withColumn("_shard", F.pmod(F.xxhash64("_sha"), F.lit(shards)).cast("int"))


def apply_changes(index: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """The index after a batch of changes: rows (_sha binary, _doc long, _op 'insert' or 'delete').

    ``index`` is what an earlier call returned (_shard, _sha, _doc), None at first. Deletes of a batch
    go before its inserts; deleting a digest that isn't live does nothing, inserting a live one keeps
    the smaller _doc. Hot digests are reduced to one row of each kind before they are dealt out.
    """
    few = changes.groupBy("_sha", "_op").agg(F.min("_doc").alias("_doc"))
    spark = changes.sparkSession
    old = index if index is not None else spark.createDataFrame([], "_shard int, _sha binary, _doc long")

    def run(live: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        filled = CuckooIndex(max(64, len(live) // 2))
        for sha, doc in zip(live._sha, live._doc, strict=True):
            filled.put(sha, doc)
        for sha in batch._sha[batch._op == "delete"]:
            filled.delete(sha)
        fresh = batch[batch._op == "insert"]
        for sha, doc in zip(fresh._sha, fresh._doc, strict=True):
            known = filled.find(sha)
            filled.put(sha, doc if known is None else min(known, doc))
        items = list(filled.items())
        shard = live._shard.iloc[0] if len(live) else batch._shard.iloc[0]
        return pd.DataFrame({"_shard": [shard] * len(items), "_sha": [k for k, _ in items], "_doc": [v for _, v in items]})

    return old.groupBy("_shard").cogroup(sharded(few, shards).groupBy("_shard")).applyInPandas(run, "_shard int, _sha binary, _doc long")
