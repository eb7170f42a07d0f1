"""Stored inventories with a digest for each bucket, so that two of them are compared by reading only what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.digests import digest, frame, joined, packed, unpacked

#: Hexadecimal characters of an id's hash that name its bucket (a folder of files) and its leaf (rows that are digested together).
BUCKET, LEAF = 2, 4


def write(entries: DataFrame, at: str, bucket: int = BUCKET, leaf: int = LEAF) -> None:
    """entries (entry_id, digest and any other columns) as Parquet by bucket, and then the index, which makes them readable.

    An existing one is never replaced. ValueError if an id or digest is null or an id comes twice; the rows then stay
    without an index. Digests cover ids and digests, not the other columns. Leaves hold about 1 in 16 ** leaf of the rows;
    raise it for more than some 10^9 of them.
    """
    if not 0 < bucket <= leaf:
        raise ValueError("a leaf is part of a bucket")
    spark, key = entries.sparkSession, F.sha2(F.coalesce(F.col("entry_id").cast("string"), F.lit("")), 256)
    placed = entries.withColumn("bucket", F.concat(F.lit("b"), F.left(key, F.lit(bucket))))  # the letter keeps it text in names of folders
    placed.limit(0).write.mode("errorifexists").parquet(f"{at}/columns")
    text = dict(entries.dtypes)["digest"] == "string"  # such digests travel as bytes, half the size
    small, whole = (packed, unpacked) if text else (lambda c: c, lambda c: c)
    placed = placed.withColumn("digest", small(F.col("digest"))).repartition("bucket").withColumn("digest", whole(F.col("digest")))
    placed.write.mode("errorifexists").option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/rows")
    pair = F.struct(F.col("entry_id").cast("string").alias("k"), small(F.col("digest")).alias("digest"))
    leaves = rows(spark, at).groupBy("bucket", F.left(key, F.lit(leaf)).alias("leaf")).agg(
        F.count("*").alias("rows"), F.countDistinct("entry_id").alias("ids"), F.count("digest").alias("digests"), F.collect_list(pair).alias("_x"))
    leaves = leaves.withColumn("_x", F.sort_array(F.transform("_x", lambda x: F.struct(x["k"].alias("k"), whole(x["digest"]).alias("digest")))))
    each = leaves.select("bucket", "leaf", "rows", "ids", "digests", digest(joined(F.transform("_x", lambda x: F.concat(frame(x["k"]), frame(x["digest"]))))).alias("_d"))
    index = each.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("ids").alias("ids"), F.sum("digests").alias("digests"), F.sort_array(F.collect_list(F.struct("leaf", "_d"))).alias("_all"))
    index = index.select("bucket", "rows", ((F.col("ids") == F.col("rows")) & (F.col("digests") == F.col("rows"))).alias("sound"), digest(joined(F.transform("_all", lambda x: F.concat(frame(x["leaf"]), frame(x["_d"]))))).alias("digest"))
    index = index.withColumn("form", F.lit(f"{bucket}:{leaf}"))
    index.write.mode("errorifexists").parquet(f"{at}/checked")
    made = spark.read.schema(index.schema).parquet(f"{at}/checked")
    if not made.where("NOT sound").isEmpty():
        raise ValueError("ids are null or come twice, or digests are null")
    made.drop("sound").coalesce(1).write.mode("errorifexists").parquet(f"{at}/index")


def rows(spark: SparkSession, at: str) -> DataFrame:
    """The entries, with their bucket."""
    return spark.read.schema(spark.read.parquet(f"{at}/columns").schema).parquet(f"{at}/rows")


def index(spark: SparkSession, at: str) -> DataFrame:
    """bucket, rows, digest, form; at most 16 ** BUCKET rows."""
    return spark.read.schema("bucket string, rows long, digest string, form string").parquet(f"{at}/index")


def changed_buckets(spark: SparkSession, expected: str, actual: str) -> list[str]:
    """Buckets whose digests differ, or that one side lacks: read from the two indexes alone."""
    e, a = index(spark, expected), index(spark, actual)
    if e.select("form").unionByName(a.select("form")).distinct().count() > 1:
        raise ValueError("the two have other buckets or leaves")
    both = e.select("bucket", F.col("digest").alias("_e")).join(a.select("bucket", F.col("digest").alias("_a")), "bucket", "full")
    return sorted(r.bucket for r in both.where(~F.col("_e").eqNullSafe(F.col("_a"))).select("bucket").collect())


def differences(spark: SparkSession, expected: str, actual: str) -> DataFrame:
    """entry_id, kind (missing, extra, mismatched), expected_digest, actual_digest. Only files of changed buckets are read."""
    buckets = changed_buckets(spark, expected, actual)
    side = lambda at, name: rows(spark, at).where(F.col("bucket").isin(buckets)).select("entry_id", F.col("digest").alias(name))
    text = dict(rows(spark, expected).dtypes)["digest"] == dict(rows(spark, actual).dtypes)["digest"] == "string"
    names = ("expected_digest", "actual_digest")
    sent = lambda at, name: side(at, name).withColumn(name, packed(F.col(name)) if text else F.col(name))
    both = sent(expected, names[0]).join(sent(actual, names[1]), "entry_id", "full")
    kind = F.when(F.col("actual_digest").isNull(), "missing").when(F.col("expected_digest").isNull(), "extra").when(F.col("expected_digest") != F.col("actual_digest"), "mismatched")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("entry_id", "kind", *[(unpacked(F.col(n)) if text else F.col(n)).alias(n) for n in names])
