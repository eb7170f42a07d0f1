"""Nearest neighbours by a block matrix join with int8 tiles and exact recomputation.

Queries and candidates are dealt over a grid: each cell holds a bounded group of queries and reads a
bounded group of candidates as a stream. For each block of candidates a tile of int8 inner products
(exact in float32, since 127 * 127 * dimensions stays below 2**24) gives approximate scores. With
x = x' + e, x' the dequantised vector, |q.c - q'.c'| <= |q'||e_c| + |e_q||c|, so a candidate whose upper
bound is below a query's k-th best lower bound can't be among its k nearest. The pairs that survive are
recomputed in double precision, by dimension in order, and merged by one heap for each query; the
heaps of all cells are merged by query at the end. No pair is dropped unless the bound proves it, so
results equal brute force.

Vectors that are null, zero, of length 0, or hold null or non-finite components take no part, nor do
rows with a null id; vectors of other lengths than the query's aren't its candidates. vec_id names a
vector: repeated rows count once, and a query's own id is no candidate. Ties go to the smaller id. An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and candidates of a cell, rows of a tile; partitions of the grid, at most, for each shuffle partition of the session.
QUERIES, CANDIDATES, TILE, CELLS = 2048, 16384, 2048, 8
LARGEST = 1000  # dimensions for which int8 tiles are exact in float32


class Block:
    """Vectors with their int8 forms and what the bounds need."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.scale = np.abs(x).max(axis=1) / 127
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            tiny = self.scale < 1e-300  # too small to divide by: quantised to 0, all of it error
            self.q = np.where(tiny[:, None], 0, np.rint(x / np.where(tiny, 1, self.scale)[:, None])).astype(np.float32)
        near = self.q * self.scale[:, None]
        self.near = np.sqrt((near * near).sum(axis=1))
        self.error = np.sqrt(((x - near) ** 2).sum(axis=1))
        self.size = np.sqrt((x * x).sum(axis=1))


def tile(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products, and bounds of their errors."""
    if q.x.shape[1] > LARGEST:
        parts = [q.q[:, k : k + LARGEST].astype(np.float32) @ c.q[:, k : k + LARGEST].T for k in range(0, q.x.shape[1], LARGEST)]
        dot = np.sum([p.astype(float) for p in parts], axis=0)
    else:
        dot = (q.q @ c.q.T).astype(float)
    bound = (np.outer(q.near, c.error) + np.outer(q.error, c.size)) * (1 + 1e-9) + np.outer(q.size, c.size) * 1e-12
    return dot * q.scale[:, None] * c.scale, bound


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed by dimension in order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Heaps:
    """The k best (score, smaller id first) of each query; an id counts once."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.k, self.ids = k, ids
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), -np.inf)

    def push(self, row: int, score: float, other: int) -> None:
        heap, entry = self.heaps[row], (score, -other)
        if len(heap) < self.k:
            if entry not in heap:
                heapq.heappush(heap, entry)
        elif entry > heap[0] and entry not in heap:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.worst[row] = heap[0][0]

    def read(self, q: Block, c: Block) -> None:
        score, bound = tile(q, c)
        own = q.ids[:, None] == c.ids[None, :]
        low = np.where(own, -np.inf, score - bound)
        least = self.worst.copy()
        if low.shape[1] >= self.k:
            least = np.maximum(least, np.partition(low, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((score + bound >= least[:, None]) & ~own)
        found = exact(q.x[row], c.x[col])
        keep = found >= self.worst[row]
        for r, s, o in zip(row[keep].tolist(), found[keep].tolist(), c.ids[col[keep]].tolist(), strict=True):
            self.push(r, s, o)

    def out(self) -> pa.RecordBatch:
        rows = [(int(q), -o, s) for q, heap in zip(self.ids, self.heaps, strict=True) for s, o in heap]
        cols = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["_query", "_other", "_score"])


def matrix(b: pa.RecordBatch) -> np.ndarray:
    flat = b.column("_v").flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(b.num_rows, -1)


def cells(k: int):
    """Reads cells (sorted by _cell; within each, queries before candidates) as a stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, block, heaps = None, [], None, None
        for b in batches:
            at = b.column("_cell").to_pylist()
            kind = b.column("_candidate").to_numpy(zero_copy_only=False)
            ends = [i for i in range(1, len(at)) if at[i] != at[i - 1] or kind[i] != kind[i - 1]]
            for first, last in zip([0, *ends], [*ends, len(at)], strict=True):
                if first == last:
                    continue
                if at[first] != cell:
                    if heaps:
                        yield heaps.out()
                    cell, parts, block, heaps = at[first], [], None, None
                part = b.slice(first, last - first)
                if not kind[first]:
                    parts.append((part.column("_id").to_numpy(), matrix(part)))
                    continue
                if not parts and block is None:
                    continue  # candidates of a length that no query has
                if block is None:
                    ids = np.concatenate([p[0] for p in parts])
                    ids, one = np.unique(ids, return_index=True)
                    block = Block(ids, np.concatenate([p[1] for p in parts])[one])
                    heaps, parts = Heaps(ids, k), []
                ids, x = part.column("_id").to_numpy(), matrix(part)
                for s in range(0, len(ids), TILE):
                    heaps.read(block, Block(ids[s : s + TILE], x[s : s + TILE]))
        if heaps:
            yield heaps.out()

    return run


def ranked(k: int):
    """Merges the heaps of all cells (sorted by _query) and numbers each query's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heaps = None, None
        out: list[tuple[int, int, int, float]] = []

        def close() -> None:
            if heaps:
                out.extend((query, n + 1, -o, s) for n, (s, o) in enumerate(sorted(heaps.heaps[0], reverse=True)))

        def batch() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for q, o, s in zip(*(b.column(c).to_pylist() for c in ("_query", "_other", "_score")), strict=True):
                if q != query:
                    close()
                    query, heaps = q, Heaps(np.array([q]), k)
                heaps.push(0, s, o)
            yield batch()
            out.clear()
        close()
        yield batch()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_asks"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = rows.where(F.col("_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("_id").agg(F.min("_v").alias("_v"), F.bool_or("_asks").alias("_asks")).withColumn("_dim", F.size("_v"))  # an id counts once in the bounds, too
    asked, there = rows.agg(F.count_if("_asks"), F.count("*")).first()
    across, down = max(1, -(-asked // QUERIES)), max(1, -(-there // CANDIDATES))
    mine = F.pmod(F.xxhash64("_id"), F.lit(across)).cast("int")
    theirs = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(down)).cast("int")
    queries = rows.where("_asks").withColumn("_row", mine).withColumn("_col", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("_candidate", F.lit(False))
    candidates = rows.withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("_col", theirs).withColumn("_candidate", F.lit(True))
    grid = queries.unionByName(candidates).withColumn("_cell", F.concat_ws(",", "_dim", "_row", "_col"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, min(across * down, CELLS * least))  # beyond that a task reads several cells, one after another
    dealt = grid.select("_cell", "_candidate", "_id", "_v").repartition(parts, "_cell").sortWithinPartitions("_cell", "_candidate")
    found = dealt.mapInArrow(cells(k), "_query long, _other long, _score double")
    return found.repartition(parts, "_query").sortWithinPartitions("_query").mapInArrow(ranked(k), "query_id long, rank int, vec_id long, score double")
