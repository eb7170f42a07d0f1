import math

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import neighbours
from driftloom.llm.neighbours import Block, exact, nearest, tile


def brute(rows, asks, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in fine:
        if asks(q):
            near = sorted(((-exact(fine[q][None], v[None])[0], i) for i, v in fine.items() if i != q and len(v) == len(fine[q])))
            out[q] = [(i, -s) for s, i in near[:k]]
    return {q: v for q, v in out.items() if v}


def test_equals_brute_force(spark, monkeypatch):
    for name, value in (("QUERIES", 7), ("CANDIDATES", 60), ("TILE", 13)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(1)
    base = r.normal(size=(20, 8)).astype(np.float32)
    rows = [(int(i), (base[i % 20] + (0.001 * r.normal(size=8) if i % 3 else 0)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400, None), (405, []), (410, [0.0] * 8), (415, [float("nan")] * 8), (420, [None] + [1.0] * 7), (425, [float("inf")] * 8), (430, [1e-38] * 8), (435, [1e30] * 8), (440, [1.0, 2.0]), (445, [2.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, _cell string").repartition(3)
    got = {}
    for x in nearest(df, F.col("vec_id") % 5 == 0, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert x.rank == len(got[x.query_id])
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(rows, lambda q: q % 5 == 0, 6)
    assert nearest(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    twice = nearest(df.unionByName(df), F.col("vec_id") % 5 == 0, k=6)
    assert twice.count() == sum(map(len, got.values()))


def test_bounds_hold():
    r = np.random.default_rng(2)
    for scale in (1, 1e-20, 1e20):
        a, b = (Block(np.arange(50), r.normal(size=(50, 64)) * scale * r.lognormal(size=(50, 1))) for _ in range(2))
        score, bound = tile(a, b)
        assert (np.abs(score - a.x @ b.x.T) <= bound).all()


def test_repeated_rows_take_no_places(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hot = df.where("vec_id = 7").crossJoin(spark.range(30).select()).select("vec_id", "embedding")
    for table in (df.unionByName(df), df.unionByName(hot)):
        got = {}
        for x in nearest(table, F.col("vec_id") % 5 == 0, k=20).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert got == brute(rows, lambda q: q % 5 == 0, 20)
