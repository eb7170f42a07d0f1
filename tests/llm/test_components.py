import random

import pytest

from driftloom.llm import components as module


def brute(links):
    up = {x: x for pair in links for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("edges", [3, 300_000])
def test_equal_union_find(spark, monkeypatch, edges):
    monkeypatch.setattr(module, "EDGES", edges)
    r = random.Random(1)
    chain = list(range(100, 118))
    r.shuffle(chain)
    links = [*zip(chain, chain[1:], strict=False), (1, 2), (2, 1), (9, 5), (5, 7), *[(50, k) for k in range(51, 60)], *[(r.randrange(200, 230), r.randrange(200, 230)) for _ in range(14)]]
    links = [x for x in links if x[0] != x[1]]
    got = {x._node: x._root for x in module.components(spark.createDataFrame(links, "_a long, _b long").repartition(4)).collect()}
    assert got == brute(links)
    assert module.components(spark.createDataFrame([], "_a long, _b long")).count() == 0
