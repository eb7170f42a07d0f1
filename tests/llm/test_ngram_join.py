import random
import re

import pytest

from driftloom.llm import ngram_join
from driftloom.llm.ngram_join import Join, near_groups, one_of_each


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common * den >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "日本", "A", "a"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    bases = [text(r.choice([1, 2, 3, 6, 12, 21, 25, 60, 150])) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "x" * 5000), (4, "x" * 5000), (5, "One  two\nTHREE"), (6, "one two three")]
    for k in range(7, n):
        w = r.choice(bases).split(" ")
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            at = r.randrange(len(w) + 1)
            w[at : at + r.choice([0, 1])] = [r.choice(vocabulary)] * r.choice([0, 1, 1])
        rows.append((k * 3 % 1009, " ".join(w)))
    return list(dict(rows).items())


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 3, 9, 10), (2, 5, 8, 10), (3, 2, 7, 10)])
def test_equals_brute_force(spark, seed, n, num, den):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _rep string, _key int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, n, num, den).collect()}
    assert got == brute(rows, n, num, den)


def test_long_lists_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "SHORT", 3)
    rows = corpus(9, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, 3, 9, 10).collect()} == brute(rows, 3, 9, 10)


def test_odd_rows(spark):
    shape = "doc_id long, text string"
    assert near_groups(spark.createDataFrame([], shape)).count() == 0
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None)], shape)
    got = sorted(((r.doc_id, r.component_id) for r in near_groups(rows).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, None), (3, 3)], key=repr)
    assert sorted((r.doc_id for r in one_of_each(rows).collect()), key=repr) == sorted([1, 1, 3, None], key=repr)


def test_light_sets_enumerate_what_a_partner_may_need():
    j = Join(3, 9, 10)
    assert j.overlaps(5) == [5] and j.overlaps(20)[0] == 18 and j.enumerated(20) == 190 + 20 + 1
    assert j.prefix(148) == 15 and j.need(148, 148) == 141
    assert ngram_join.boundary(j, {5: 10, 30: 1000}, {5: 1000, 30: 3000}) == 29


def test_words_and_groups_that_hashes_or_sketches_could_confuse(spark):
    one = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, one), (4, two), (5, two)]
    r = random.Random(5)
    base = [f"v{k}" for k in range(900)]
    for i in range(10, 40):  # a group just below the threshold: no links, and no pair may be taken for one
        w = list(base)
        for k in r.sample(range(900), 28):
            w[k] = f"u{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == brute(rows, 3, 9, 10) and got[5][1] == 4 and got[1][1] != got[4][1]
