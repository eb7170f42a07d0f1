"""Checks of contents as they arrive: a stream of (path, content) against a static table of snippets.

The join is stateless: every version of a file that arrives is checked once. A watermark and
``dropDuplicatesWithinWatermark`` drop repeated deliveries of the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftloom.operators import matching
from driftloom.sources.documents import source_lines

FILES = "path string, modificationTime timestamp, length long, content binary"


def outcomes(stream: DataFrame, snippets: DataFrame) -> DataFrame:
    """snippet_id, path, kind, hits for every snippet of each file that arrives; works on streams and on tables."""
    lines = source_lines(stream)
    met = snippets.join(lines, "path").withColumn("starts", matching.starts(F.col("lines"), F.col("code")))
    kind = F.when(F.size("starts") == 0, "not_matched").when((F.col("occurrence") == "exactly_one") & (F.size("starts") > 1), "occurrence_mismatch").otherwise("satisfied")
    return met.select("snippet_id", "path", kind.alias("kind"), F.size("starts").alias("hits"))


def start(stream: DataFrame, snippets: DataFrame, out: str, checkpoint: str, delay: str | None = None) -> StreamingQuery:
    """Appends outcomes to Parquet, exactly once; delay: how late a repeated delivery may come (needs modificationTime)."""
    if delay is not None:
        stream = stream.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path", "digest"])
    return outcomes(stream, snippets).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
