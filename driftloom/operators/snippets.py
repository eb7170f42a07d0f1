"""Diff and refresh of snippet contracts.

snippets(snippet_id, source_file, linked_signature, signature_type, occurrence, code array<string>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.digests import DOMAIN, count_frame, digest, frame, framed, joined, lines_digest
from driftloom.operators.inventory import tree_digest

FIELDS = ("source_file", "linked_signature", "signature_type", "occurrence", "code")


def diffed(previous: DataFrame, current: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """snippet_id, change (added, removed, changed), fields (changed ones in their fixed order, joined by commas) and code digests."""
    side = lambda df, x: df.select("snippet_id", *[F.col(f).alias(f"{x}{f}") for f in FIELDS], F.lit(True).alias(f"{x}here"))
    both = side(current, "c_").join(side(previous, "p_"), "snippet_id", "full_outer")
    fields = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"c_{f}").eqNullSafe(F.col(f"p_{f}")), F.lit(f)) for f in FIELDS])), ",")
    change = F.when(F.col("p_here").isNull(), "added").when(F.col("c_here").isNull(), "removed").otherwise("changed")
    out = both.select("snippet_id", change.alias("change"), F.when(change == "changed", fields).otherwise("").alias("fields"), *[F.when(F.col(f"{x}here"), lines_digest(F.col(f"{x}code"), domain)).alias(name) for x, name in (("p_", "previous_code"), ("c_", "current_code"))])
    return out.where("change <> 'changed' OR fields <> ''")


def catalog_digest(snippets: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """One row: the number of snippets and the tree digest of all of them, in the order of their ids' digests. Each snippet is hashed where it lies."""
    lines = joined(F.transform("code", lambda x: frame(F.encode(x, "ISO-8859-1"))))
    fields = F.concat(*[frame(F.col(f)) for f in ("snippet_id", "source_file", "linked_signature", "signature_type")], framed("exact_lines_v1"), frame(F.col("occurrence")), count_frame(F.size("code")), lines)
    rows = snippets.select(F.sha2(F.col("snippet_id"), 256).alias("_key"), digest(fields).alias("_own"))
    return tree_digest(rows, F.col("_key"), F.col("_own"), framed(f"{domain}:contract"), "digest").select(F.col("_n").alias("snippets"), "digest")


def refreshed(snippets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Snippets with the code of their seeds (snippet_id, code): ``changed`` where it differs, ``linked`` where there is a seed; others stay."""
    fresh = seeds.select("snippet_id", F.col("code").alias("_new"))
    out = snippets.join(fresh, "snippet_id", "left")
    return out.withColumn("linked", F.col("_new").isNotNull()).withColumn("changed", F.col("linked") & (F.col("code") != F.col("_new"))).withColumn("code", F.coalesce("_new", "code")).drop("_new")


def uncovered(snippets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Snippets without a seed: a full refresh needs this to be empty."""
    return snippets.join(seeds.select("snippet_id"), "snippet_id", "left_anti")
