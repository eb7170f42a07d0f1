"""Source trees as (path, content), read by Spark's binaryFile source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, extension: str | None = ".rs") -> DataFrame:
    """All regular files below root with the extension (any case), path relative to it. A reader that needs no content doesn't load it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    full = F.regexp_replace("path", "^file:/*", "/")
    out = files.select(F.substring(full, F.length(base) + 2, F.length(full)).alias("path"), "content")
    return out if extension is None else out.where(F.endswith(F.lower("path"), F.lit(extension.lower())))


def contract_files(spark: SparkSession, root: str, metadata: str = ".driftloom/") -> DataFrame:
    """All files of a contracts folder but its metadata."""
    return scan(spark, root, None).where(~F.startswith("path", F.lit(metadata)))


def selected(sources: DataFrame, files: DataFrame) -> DataFrame:
    """The listed files (path); those that aren't there have a null content, which callers refuse."""
    return files.select("path").distinct().join(sources, "path", "left")


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose bytes differ or that are gone, in path order: the first is the one to report."""
    later = now.select("path", F.sha2("content", 256).alias("_now"))
    both = before.select("path", F.sha2("content", 256).alias("_before")).join(later, "path", "left")
    return both.where(~F.col("_before").eqNullSafe(F.col("_now"))).select("path").orderBy("path")
