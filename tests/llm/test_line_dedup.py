import math
import random

from pyspark.sql import functions as F

from driftloom.llm import line_dedup
from driftloom.llm.line_dedup import line_report, without_repeated_lines


def brute(rows):
    lines = [(i, n, frozenset(w for w in x.split(" ") if w)) for i, t in sorted(x for x in rows if x[0] is not None) if t is not None for n, x in enumerate(t.split("\n"))]
    gone = set()
    for k, (i, n, s) in enumerate(lines):
        if s and any(e and len(s & e) * 10 >= 8 * len(s | e) for _, _, e in lines[:k]):
            gone.add((i, n))
    return gone


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["é", "日本"]
    base = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 4, 5, 9, 20, 40]))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n \n"), (3, "a" * 50_000 + "\n" + "a" * 50_000)]
    for i in range(4, 90):
        lines = []
        for _ in range(r.randrange(0, 6)):
            w = r.choice(base).split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.2:
                r.shuffle(w)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COUNTERS", 256)
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _key int, _set string").repartition(5)
        got = {(r.doc_id, int(n)) for r in line_report(df).collect() for n in r.removed.split(",") if n}
        assert got == brute(rows)
        kept = {r.doc_id: r.text for r in without_repeated_lines(df).collect()}
        assert kept == {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in got) for i, t in rows}


def test_odd_rows(spark):
    shape = "doc_id long, text string"
    assert line_report(spark.createDataFrame([], shape)).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (2, "a b c\nx"), (2, "a b c\nx"), (3, "x\ny")], shape)
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in line_report(rows).collect()), key=repr)
    assert got == sorted([(None, 1, 0, ""), (None, 1, 0, ""), (2, 2, 0, ""), (2, 2, 0, ""), (3, 2, 1, "0")], key=repr)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b\nc d e f g"), (2, "c d e f g\nh")], "doc_id long, text string")
    plan = line_report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_many_lines_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "EARLIEST", 2)
    monkeypatch.setattr(line_dedup, "BLOCK", 40)
    r = random.Random(7)
    base = [f"t{k}" for k in range(24)]
    lines = []
    for k in range(600):
        w = list(base)
        for x in r.sample(range(24), r.choice([1, 2, 3, 3, 4])):
            w[x] = f"n{r.randrange(300)}"
        lines.append(" ".join(w))
    rows = [(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, int(n)) for x in line_report(df).collect() for n in x.removed.split(",") if n}
    assert got == brute(rows) and len(got) > 200


def test_sketches_never_exceed_the_difference(spark):
    """Of lines on both sides of the size from which sketches have 128 bits; those of short lines are narrow."""
    r = random.Random(11)
    rows = []
    for k in range(120):
        n = line_dedup.SHORT + r.randrange(-12, 13)
        base = [r.getrandbits(63) for _ in range(n)] if k % 2 == 0 else [w if r.random() < 0.9 else r.getrandbits(63) for w in base] + [r.getrandbits(63) for _ in range(r.randrange(8))]
        rows.append((k, len(base), sorted(base)))
    few = line_dedup.sketched(spark.createDataFrame(rows, "k int, _n int, _set array<long>"))
    assert all((x._s2 == 0) == (x._n <= line_dedup.SHORT) for x in few.collect())
    pairs = few.alias("l").join(few.alias("e"), F.col("l.k") < F.col("e.k")).select(line_dedup.apart().alias("d"), "l._set", F.col("e._set").alias("other")).collect()
    assert len(pairs) == 7140 and all(x.d <= len(set(x._set) ^ set(x.other)) for x in pairs)


def test_texts_are_read_once_after_the_postings(spark, tmp_path):
    """What the last joins need, the numbers of lines too, comes from one reading, and lines are put in order without decimals."""
    rows = [(None, "a b c d e\nx"), (-5, "a b c d e\n\nx"), (1, None), (2, "x\na  b c d f\na b c d e f"), (2, "x\na  b c d f\na b c d e f"), (3, "f e d c b a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    report = line_report(spark.read.parquet(str(tmp_path / "documents")))
    plan = report._jdf.queryExecution().optimizedPlan().toString() + report._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and "decimal" not in plan
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in report.collect()), key=repr)
    assert got == sorted([(None, 2, 0, ""), (-5, 3, 0, ""), (1, 1, 0, ""), (2, 3, 2, "0,2"), (2, 3, 2, "0,2"), (3, 1, 1, "0")], key=repr)


def test_packed_postings(spark):
    """Sizes and places come back as they were."""
    r = random.Random(5)
    rows = [(k, n, r.randrange(n - (8 * n + 9) // 10 + 1), r.getrandbits(63), r.getrandbits(63)) for k in range(60) for n in [r.choice([1, 4, 9, 47, 48, 49, 60, 2**31 - 1])]]
    wide = spark.createDataFrame(rows, "k int, _n int, _pos int, _s1 long, _s2 long")
    back = line_dedup.packed(wide).select("k", *[c.alias(x) for c, x in zip(line_dedup.unpacked("_at"), ("n", "pos"))])
    assert sorted(back.collect()) == sorted((k, n, pos) for k, n, pos, _, _ in rows)


def test_the_table_of_classes_is_in_no_text_of_a_plan(spark, monkeypatch):
    """Spark's driver makes a text of each plan, again after each stage; the table, of fixed size, comes from a subquery, and no row holds it."""
    texts, optimised = [], []

    def noted(df, keep=line_dedup.written):
        texts.append(len(df._jdf.queryExecution().toString()))
        optimised.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    monkeypatch.setattr(line_dedup, "written", noted)
    rows = corpus(3)
    got = {(r.doc_id, int(n)) for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for n in r.removed.split(",") if n}
    assert got == brute(rows)
    assert max(texts) < 150_000
    made = [x for p in optimised for x in p.split("\n") if "array_except" in x]
    assert made and all("coalesce(scalar-subquery#" in x and "_classes#" not in x for x in made)


def test_classes_of_words(spark, monkeypatch):
    """Each counter's class is log2 of its count against the mean, from 0 to 15, and ranks come before hashes; without words all are 0."""
    monkeypatch.setattr(line_dedup, "COUNTERS", 16)
    words = ["a"] * 3000 + ["b"] * 200 + ["c"] * 9 + ["d"]
    docs = spark.createDataFrame([(1, " ".join(words[:2000]) + "\n\n" + " ".join(words[2000:])), (2, None)], "doc_id long, text string")
    at = {r.w: (r.h, r.h & 15) for r in spark.createDataFrame([(w,) for w in "abcd"], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    counts = [0] * 16
    for w in words:
        counts[at[w][1]] += 1
    classes = [max(0, min(15, math.floor(math.log2(n / (len(words) / 16))) + 6)) if n else 0 for n in counts]
    table = line_dedup.rarity(docs, "text")
    assert [x >> 59 for x in table.first()._classes] == classes and len(set(classes)) > 2
    lines = spark.createDataFrame([("a b c d a  b",), (" ",)], "_line string")
    got = [r._set for r in line_dedup.with_sets(lines, table, "_line").orderBy(F.desc("_n")).collect()]
    assert got == [sorted(classes[k] << 59 | (h % 2**64) >> 5 for h, k in at.values()), []]
    assert line_dedup.rarity(docs.where("false"), "text").first()._classes == [0] * 16
