"""Connected components of links: local contraction in tasks of bounded size, large-star and small-star rounds between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import written

#: Edges that one task contracts, about; with no more than these in all, a single contraction is the result.
EDGES = 300_000


def contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a partition's edges with the smallest node that they lead to."""
    held = [np.stack([b.column(k).to_numpy() for k in (0, 1)]) for b in batches]
    u, v = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        up[max(x, y)] = min(x, y)
    for k in range(len(up)):  # parents come first, being smaller
        up[k] = up[up[k]]
    root = nodes[np.array(up, int)] if len(nodes) else nodes
    inner = nodes != root
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner], pa.int64()), pa.array(root[inner], pa.int64())], ["_u", "_v"])


def components(links: DataFrame) -> DataFrame:
    """_node, _root (the component's smallest node) for every node of the links (_a, _b: long, not null).

    Edges (_u > _v) are contracted in tasks of about EDGES; while there are several such tasks, rounds of
    joins and groupings on a node bring stars together, until nothing changes. Hot nodes are met by
    partial aggregation and by splitting skewed joins. Only a count and a checksum reach the driver.
    """
    edges = written(links.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).where("_u <> _v"))
    before = None
    while True:
        parts = -(-edges.count() // EDGES)
        edges = written(edges.coalesce(max(1, parts)).mapInArrow(contracted, "_u long, _v long"))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if parts <= 1 or now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        large = both.join(least, "_u").where("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        low = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(low, "_u").where("_v <> _m").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).unionByName(low.withColumnRenamed("_m", "_v"))
        edges = written(small.distinct())
    roots = edges.select(F.col("_v").alias("_node")).distinct()
    return edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_root")).unionByName(roots.withColumn("_root", F.col("_node")))
