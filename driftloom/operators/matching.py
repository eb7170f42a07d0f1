"""Matching snippets against sources: occurrences, outcomes, evidence, counts.

sources(path, lines array<string>); snippets(snippet_id, path, occurrence, code array<string>, ...). Sources
are pruned to the paths that snippets name before their lines meet them. Two ways to find windows give
equal results: ``starts`` compares inside a row, and ``starts_by_first_line`` joins exploded lines on
(path, first line), which keeps single huge files or files with very many snippets from one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans kept of all that are counted.
SPANS = 32


def referenced(sources: DataFrame, snippets: DataFrame) -> DataFrame:
    """Sources that some snippet names."""
    return sources.join(snippets.select("path"), "path", "left_semi")


def starts(lines: Column, code: Column) -> Column:
    """1-based starts of all windows of ``lines`` that equal ``code``, overlapping ones too."""
    last = F.size(lines) - F.size(code) + 1
    hit = lambda i: (F.element_at(lines, i) == F.element_at(code, 1)) & (F.slice(lines, i, F.size(code)) == code)
    return F.when((F.size(code) > 0) & (last > 0), F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), hit)).otherwise(F.array().cast("array<int>"))


def starts_by_first_line(sources: DataFrame, snippets: DataFrame) -> DataFrame:
    """snippet_id, starts: for snippets with a hit, by an equi join on the first line and a check of the rest."""
    numbered = referenced(sources, snippets).select("path", F.posexplode("lines").alias("_at", "_line"))
    flat = snippets.where(F.size("code") > 0).select("snippet_id", "path", F.posexplode("code").alias("_k", "_line")).withColumn("_need", F.lit(None).cast("int"))
    first = flat.where("_k = 0").join(numbered, ["path", "_line"]).select("snippet_id", F.col("_at").alias("_start"), "path")
    need = snippets.select("snippet_id", F.size("code").alias("_size"))
    rest = first.join(flat.select("snippet_id", "_k", "_line"), "snippet_id").withColumn("_at", F.col("_start") + F.col("_k"))
    full = rest.join(numbered, ["path", "_at", "_line"]).groupBy("snippet_id", "_start").agg(F.count("*").alias("_n")).join(need, "snippet_id").where("_n = _size")
    return full.groupBy("snippet_id").agg(F.sort_array(F.collect_list((F.col("_start") + 1).cast("int"))).alias("starts"))


def matched(snippets: DataFrame, sources: DataFrame) -> DataFrame:
    """Snippets with ``present``, ``starts`` and ``kind``: satisfied, missing_file, not_matched or occurrence_mismatch."""
    found = snippets.join(referenced(sources, snippets).select("path", "lines"), "path", "left").withColumn("starts", starts(F.coalesce("lines", F.array().cast("array<string>")), F.col("code")))
    kind = (
        F.when(F.col("lines").isNull(), "missing_file")
        .when(F.size("starts") == 0, "not_matched")
        .when((F.col("occurrence") == "exactly_one") & (F.size("starts") > 1), "occurrence_mismatch")
        .otherwise("satisfied")
    )
    return found.withColumn("present", F.col("lines").isNotNull()).withColumn("kind", kind)


def spans(matches: DataFrame, most: int = SPANS) -> DataFrame:
    """snippet_id, nth, start_line, end_line (1-based, inclusive) of the first hits, and total, the number of all."""
    each = matches.select("snippet_id", F.size("starts").cast("long").alias("total"), F.size("code").alias("_k"), F.posexplode(F.slice("starts", 1, most)).alias("nth", "start_line"))
    return each.select("snippet_id", (F.col("nth") + 1).cast("long").alias("nth"), F.col("start_line").cast("long"), (F.col("start_line") + F.col("_k") - 1).cast("long").alias("end_line"), "total")


def nearest(matches: DataFrame) -> DataFrame:
    """For snippets without a hit: the earliest window with the most equal aligned lines.

    Windows start at every line and may run past the end. Aligned equal lines are joined on (snippet, line),
    so the cost follows the number of equal lines, not lines times snippet length.
    """
    misses = matches.where((F.col("kind") == "not_matched") & (F.size("lines") > 0) & (F.size("code") > 0))
    near = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("_line"), (i + 1).alias("_at"))), lambda s: F.array_contains("code", s["_line"]))
    have = misses.select("snippet_id", F.explode(near).alias("_x")).select("snippet_id", "_x._line", "_x._at")
    want = misses.select("snippet_id", F.posexplode("code").alias("_k", "_line"))
    scores = have.join(want, ["snippet_id", "_line"]).withColumn("start_line", F.col("_at") - F.col("_k")).where("start_line >= 1").groupBy("snippet_id", "start_line").agg(F.count("*").alias("score"))
    best = scores.groupBy("snippet_id").agg(F.max(F.struct("score", (-F.col("start_line")).alias("_first"))).alias("_b"))
    out = misses.select("snippet_id", F.size("lines").alias("_n"), F.size("code").alias("_k")).join(best, "snippet_id", "left")
    start = F.coalesce(-F.col("_b._first"), F.lit(1))  # a score of 0 still has the first window
    return out.select("snippet_id", start.cast("long").alias("start_line"), F.least(start + F.col("_k") - 1, F.col("_n")).cast("long").alias("end_line"), F.coalesce("_b.score", F.lit(0)).cast("long").alias("score"))


def counts(matches: DataFrame) -> DataFrame:
    """One row of counters; paths are counted once each."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return matches.agg(
        F.count("*").alias("snippets"), of("satisfied").alias("satisfied"), of("missing_file").alias("missing_file"), of("not_matched").alias("not_matched"), of("occurrence_mismatch").alias("occurrence_mismatch"),
        F.countDistinct("path").alias("referenced_paths"), F.countDistinct(F.when(F.col("present"), F.col("path"))).alias("present_paths"),
    )


def diagnostics(matches: DataFrame) -> DataFrame:
    """Snippets that aren't satisfied, with their rank for ordered output: missing_file, not_matched, occurrence_mismatch."""
    rank = F.when(F.col("kind") == "missing_file", 0).when(F.col("kind") == "not_matched", 1).otherwise(2)
    return matches.where("kind <> 'satisfied'").withColumn("rank", rank)


def numbered(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """1-based occurrence of each row among rows of equal keys."""
    return items.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
