import math

import pytest
from pyspark.sql import functions as F

from driftloom.llm.mixing import hashed, mixed, number, rates


def test_counts_invert_the_distribution_and_hold_the_mean(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN 'big' WHEN id % 2 = 0 THEN 'small' END AS source", "'t' AS text", "id AS _n")
    got = mixed(df, seed=3, weights={"big": 1.0, "small": 1.0}, size=1.5)
    copies = got.groupBy("doc_id", "source").count().collect()
    per = {"big": {}, "small": {}}
    for r in copies:
        per[r.source][r.doc_id] = r["count"]
    assert set(per) == {"big", "small"}  # a null source has no weight here
    for name, n in (("big", 4000), ("small", 1000)):
        rate = 0.5 * 6000 * 1.5 / n
        assert abs(sum(per[name].values()) / n - rate) < 4 * math.sqrt(rate / n)
    u = {r.doc_id: r.u for r in df.select("doc_id", (number(hashed(3, "doc_id"), 13) / float(1 << 52)).alias("u")).collect()}
    rate = 1.125
    for doc in range(0, 3000):
        if doc % 3:
            k, term = 0, math.exp(-rate)
            total = term
            while total <= u[doc]:
                k += 1
                term *= rate / k
                total += term
            assert per["big"].get(doc, 0) == k
    assert got.columns == [*df.columns, "copy", "order_key"]
    assert sorted(got.collect()) == sorted(mixed(df.repartition(7), seed=3, weights={"big": 1.0, "small": 1.0}, size=1.5).collect())


def test_odd_rows(spark):
    shape = "doc_id long, source string, text string"
    assert mixed(spark.createDataFrame([], shape)).count() == 0
    df = spark.createDataFrame([(None, None, None), (1, None, ""), (1, "a", "x"), (1, "a", "x")], shape)
    assert {r._source for r in rates(df).collect()} == {None, "a"}
    out = mixed(df, size=50.0)
    assert out.where("source IS NULL").count() > 0 and out.where("source = 'a'").count() % 2 == 0
    with pytest.raises(ValueError):
        mixed(df.withColumnRenamed("text", "Copy"))
    copies = mixed(df, size=10_000.0).groupBy("doc_id", "source").count().collect()
    assert sum(r["count"] for r in copies) > 30_000


def test_large_rates(spark):
    df = spark.range(8).selectExpr("id AS doc_id", "CASE WHEN id < 4 THEN 'a' ELSE 'b' END AS source", "'t' AS text")
    for rate in (600.0, 5000.0):
        got = {r.doc_id: (r.n, r.d) for r in mixed(df, seed=3, size=rate).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d")).collect()}
        for r in df.select("doc_id", (number(hashed(3, "doc_id"), 13) / float(1 << 52)).alias("u")).collect():
            k, total = 0, math.exp(-rate)
            while total <= r.u:
                k += 1
                total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            assert got[r.doc_id] == (k, k)
