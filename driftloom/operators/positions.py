"""Positions in contents: line and column to byte, and the document of a YAML stream that a line is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_offsets(texts: DataFrame) -> DataFrame:
    """path, line (from 1), first (byte offset), bytes (without the line feed) of (path, text), one character for each byte.

    A line begins after the bytes of the lines before it: a running sum by the line's number, in time linear
    in the lines. Only numbers are shuffled, no text, and a file of any size is spilled, not held. Rows of one
    path are told apart by an id, so that a path given twice has its offsets twice.
    """
    sizes = texts.select("path", "text", F.monotonically_increasing_id().alias("_row")).select("path", "_row", F.posexplode(F.transform(F.split("text", "\n", -1), F.length)).alias("_k", "_n"))
    before = Window.partitionBy("_row").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("_n").cast("long") + 1).over(before), F.lit(0).cast("long"))
    return sizes.select("path", (F.col("_k") + 1).cast("long").alias("line"), first.alias("first"), F.col("_n").cast("long").alias("bytes"))


def resolved(coordinates: DataFrame, offsets: DataFrame) -> DataFrame:
    """Coordinates (path, line, column from 1) with their byte; null where the line or the column isn't there."""
    joined = coordinates.join(offsets, ["path", "line"], "left")
    return joined.withColumn("byte", F.when(F.col("column").between(1, F.col("bytes") + 1), F.col("first") + F.col("column") - 1)).drop("first", "bytes")


def document_of(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Each (path, line) with the index of the last document (path, start, document_index) that starts at or before it.

    Lines and starts are merged by one window over each path, not joined by range.
    """
    both = lines.select("path", "line", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("document_index")).unionByName(starts.select("path", F.col("start").alias("line"), F.lit(0).alias("_kind"), "document_index"))
    seen = Window.partitionBy("path").orderBy("line", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("document_index", F.last("document_index", ignorenulls=True).over(seen)).where("_kind = 1").drop("_kind")
