import hashlib
import random
import zlib

import pytest

from driftloom.llm.prefix_trie import rebuilt, trie, turns_of

SHAPE = "conv_id long, items array<struct<digest: string, n: long>>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(convs):
    """The nodes of {conv_id: sequence of (element, size)}, each prefix on its own."""
    nodes = {}
    for c, items in convs.items():
        for d in range(len(items) + 1):
            nodes.setdefault(tuple(items[:d]), []).append(c)
    out = set()
    for node, members in nodes.items():
        below = [k for k in nodes if k[: len(node)] == node]
        leaf = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        out.add((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(k) == len(node) + 1 for k in below), len(leaf),
            sum((len(nodes[k]) - 1) * k[-1][1] for k in below if k), sha(",".join(str(c) for c in sorted(members) if len(convs[c]) == len(node))),
        ))
    return out


def item(word):
    return (hashlib.md5(word.encode()).hexdigest(), len(word))


def got(df):
    rows = df.collect()
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("seed, each", [(1, 1), (2, 3), (3, 7), (4, 1000)])
def test_equals_every_prefix(spark, seed, each):
    r = random.Random(seed)
    words = ["a", "bb", "", "dddd"]
    convs = {}
    for c in range(-3, 60):
        if convs and r.random() < 0.5:  # copies, prefixes and extensions
            other = r.choice(list(convs.values()))
            convs[c] = other[: r.randrange(len(other) + 1)] + tuple(item(r.choice(words)) for _ in range(r.randrange(3)))
        else:
            convs[c] = tuple(item(r.choice(words)) for _ in range(r.randrange(6)))
    df = spark.createDataFrame(list(convs.items()), SHAPE).repartition(3)
    assert got(trie(df, each=each)) == plain(convs)


@pytest.mark.parametrize("each", [1, 1000])
def test_long_unary_paths_and_copies(spark, each):
    long = tuple(item(f"w{k}") for k in range(120))
    convs = {1: long, 2: long[:70], 3: long, 4: (), 5: (), 6: long[:119] + (item("z"),), **{k: long[:70] for k in range(10, 40)}}
    assert got(trie(spark.createDataFrame(list(convs.items()), SHAPE), each=each)) == plain(convs)


def test_edge_tables(spark):
    assert trie(spark.createDataFrame([], SHAPE)).count() == 0
    assert got(trie(spark.createDataFrame([(7, [])], SHAPE))) == {(7, 0, None, 1, 0, 1, 0, sha("7"))}
    assert got(trie(spark.createDataFrame([(7, None), (None, [item("x")])], SHAPE))) == {(7, 0, None, 1, 0, 1, 0, sha("7"))}


def test_turns_and_rebuilding(spark):
    r, rows = random.Random(5), []
    for c in [0, 1, 2, 3, 7, 99, 101, 150, 200, 201, 203]:
        rows += [(c, None if t == 3 and c % 2 else t, r.choice(["user", None, ""]), r.choice(["é" * 3, None, "", "x y"]), "other") for t in range(r.randrange(1, 9))]
    rows += [(None, 0, "user", "lost", "other")]
    shape = "conv_id long, turn long, role string, text string, items string"
    own = {}
    for c, t, role, text, _ in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], -1 if x[1] is None else x[1])):
        own.setdefault(c, []).append((hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), len(text or "")))
    want = {}
    for c, items in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = tuple(own.get(c - c % 100, [])[:h] + items[h:])
    r.shuffle(rows)
    found = rebuilt(turns_of(spark.createDataFrame(rows, shape)))
    assert {x.conv_id: tuple(tuple(y) for y in x["items"]) for x in found.collect()} == want
    assert got(trie(found, each=2)) == plain(want)
    assert rebuilt(turns_of(spark.createDataFrame([], shape))).count() == 0


def test_repeated_turns_have_one_order(spark):
    rows = [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "b")]
    shape = "conv_id long, turn long, role string, text string"
    first, second = (turns_of(spark.createDataFrame(x, shape)).first()["items"] for x in (rows, rows[::-1]))
    assert first == second and len(first) == 3
