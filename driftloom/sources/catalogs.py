"""Catalogs and ownership manifests in JSON, as rows with a fault where they break a rule; contract folders that may be absent."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.paths import valid
from driftloom.sources import trees

OWNED = "version int, journal struct<state: string, generation: bigint, files: struct<documents: array<struct<path: string, sha256: string>>>>"


def entries(text: str | None) -> list[tuple]:
    """(path, content) pairs of one catalog in order, equal keys included; None if it isn't one."""
    try:
        found = json.loads(text or "", object_pairs_hook=list)
    except (ValueError, RecursionError):  # not JSON, or nested too deeply
        return None
    if (text or "").lstrip().startswith("["):
        found = [tuple(dict(x).get(k) for k in ("path", "content")) if isinstance(x, list) and len(x) == 2 else (None, None) for x in found]
    good = isinstance(found, list) and all(isinstance(x, tuple) and all(isinstance(y, str) for y in x) for x in found)
    return found if good else None


def json_catalog(catalogs: DataFrame) -> DataFrame:
    """name, path, content, fault of catalogs (name, text): a JSON object from path to text, or an array of {path, content}.

    Faults: syntax (one row for the catalog), invalid_path, duplicate_path. An empty catalog has no rows.
    Python reads a catalog where it lies, since JSON functions keep one of two equal keys in silence.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [(n, entries(t)) for n, t in zip(b.name, b.text, strict=True)]
            rows = [(n, p, c, False) for n, found in each for p, c in found or ()] + [(n, None, None, True) for n, found in each if found is None]
            yield pd.DataFrame(rows, columns=["name", "path", "content", "bad"])

    rows = catalogs.select("name", "text").mapInPandas(run, "name string, path string, content string, bad boolean")
    times = F.count("*").over(Window.partitionBy("name", "path"))
    fault = F.when(F.col("bad"), "syntax").when(~valid(F.col("path")), "invalid_path").when(F.col("_times") > 1, "duplicate_path")
    return rows.withColumn("_times", times).select("name", "path", "content", fault.alias("fault"))


def ownership(manifests: DataFrame, version: int = 3) -> DataFrame:
    """name, generation, path, sha256, fault of manifests (name, text). Faults: syntax, version, updating, generation, unsorted, duplicate_path, invalid_path."""
    m = manifests.select("name", F.from_json("text", OWNED).alias("m"))
    docs = F.coalesce("m.journal.files.documents", F.array().cast("array<struct<path: string, sha256: string>>"))
    names = F.transform(docs, lambda d: d["path"])
    fault = (
        F.when(F.col("m").isNull() | F.col("m.version").isNull() | F.col("m.journal").isNull(), "syntax")
        .when(F.col("m.version") != version, "version")
        .when(F.col("m.journal.state") != "committed", "updating")
        .when(F.coalesce(F.col("m.journal.generation"), F.lit(0)) <= 0, "generation")
        .when(F.size(names) != F.size(F.array_distinct(names)), "duplicate_path")
        .when(names != F.array_sort(names), "unsorted")
        .when(~F.forall(names, lambda p: valid(p)), "invalid_path")
    )
    one = m.select("name", F.col("m.journal.generation").alias("generation"), docs.alias("_docs"), fault.alias("fault"))
    return one.select("name", "generation", F.explode_outer(F.when(F.col("fault").isNull(), F.col("_docs"))).alias("_d"), "fault").select("name", "generation", "_d.path", "_d.sha256", "fault")


def optional_contracts(spark: SparkSession, root: str) -> DataFrame:
    """Contract files (path, content) of a folder; none where the folder isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return trees.contract_files(spark, root)
    return spark.createDataFrame([], "path string, content binary")
