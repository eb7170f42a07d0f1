import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm import queries
from driftloom.llm.runs import lyndon, periodic_runs, runs_of


def plain_runs(w, times, least):
    """By the definition: for each period, the longest stretches whose words equal those a period on, unless a smaller period fits."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and w[end] == w[end + q]:
                end += 1
            if end > start:
                length = end - start + q
                if length >= 2 * q and not any(all(w[k] == w[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                    found[start, q] = length
            start = end + 1
    return sorted(((s, length, q) for (s, q), length in found.items() if length >= max(least, times * q)), key=lambda r: (r[0], r[2]))


@settings(max_examples=1500, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60)), st.integers(2, 5), st.integers(2, 8))
def test_equals_the_definition(words, times, least):
    assert runs_of(words, times, least) == plain_runs(words, times, least)


def test_periodic_texts():
    r = random.Random(5)
    for _ in range(400):
        root = [r.randrange(3) for _ in range(r.randrange(1, 9))]
        words = [r.randrange(3) for _ in range(r.randrange(5))] + root * r.randrange(1, 8) + root[: r.randrange(len(root))] + [r.randrange(3) for _ in range(r.randrange(5))]
        words = words * r.randrange(1, 3)
        for times in (2, 3, 4):
            assert runs_of(words, times, 6) == plain_runs(words, times, 6)


@given(st.lists(st.integers(0, 2), max_size=40))
def test_next_smaller_suffixes(s):
    after, ahead = lyndon(s)
    for i in range(len(s)):
        j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
        assert after[i] == j
        if j < len(s):
            same = 0
            while j + same < len(s) and s[i + same] == s[j + same]:
                same += 1
            assert ahead[i] == same


class Counted(int):
    """A word that counts how often words are compared for equality."""

    reads = 0

    def __eq__(self, other):
        Counted.reads += 1
        return int.__eq__(self, other)

    __hash__ = int.__hash__


def families(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    yield "Fibonacci", b[:n]
    yield "Thue-Morse", [bin(k).count("1") & 1 for k in range(n)]
    yield "one word", [0] * n
    yield "rising roots", [0, 1] * (n // 2)
    yield "block roots", ([0, 1] * 10 + [1]) * (n // 21)
    yield "nested roots", (([0, 0, 1] * 5 + [1]) * 5 + [2]) * (n // 81)
    yield "rising blocks", [x for k in range(1, int((2 * n) ** 0.5)) for x in [0] * k + [1]]
    yield "falling blocks", [x for k in range(int((2 * n) ** 0.5), 0, -1) for x in [0] * k + [1]]
    yield "half and half", [0] * (n // 2) + [1] + [0] * (n // 2)
    yield "period doubling", [(k & -k).bit_length() & 1 for k in range(1, n)]
    yield "ruler", [(k & -k).bit_length() for k in range(1, n)]
    yield "random", [random.Random(1).randrange(2) for _ in range(n)]


def test_comparisons_grow_with_the_text():
    for name, s in families(20_000):
        for order in (s, [max(s) - x for x in s]):
            words = [Counted(x) for x in order]
            Counted.reads = 0
            lyndon(words)
            assert Counted.reads < 6 * len(s), (name, Counted.reads / len(s))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w, 4, 6)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone))]
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *sha)


def test_query_equals_plain_version(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(["ka", "lo", "mi", "tu\t", "\n"]) for _ in range(r.randrange(1, 60)))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "a " * 500), (303, "a " * 500), (304, "é ü " * 40 + "x y"), (305, "x" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted((tuple(x) for x in out.select(columns).collect()), key=str)
    assert found == sorted((expected(*row) for row in rows), key=str)
    assert sum(1 for x in found if x[1]) > 20


def test_rows(spark):
    df = spark.createDataFrame([(None, "a a a a a a b", "x"), (1, None, None)], "doc_id long, text string, _text string")
    found = {x.doc_id: x for x in periodic_runs(df, prefix="p_").collect()}
    assert [tuple(x) for x in found[None].p_runs] == [(0, 6, 1)] and tuple(found[None].p_best) == (0, 6, 1) and found[None].p_collapsed == "a b" and found[None]._text == "x"
    assert found[1].p_runs == [] and found[1].p_best is None and found[1].p_collapsed == ""
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df.withColumnRenamed("_text", "Best"))
    with pytest.raises(ValueError):
        periodic_runs(df, times=1)
