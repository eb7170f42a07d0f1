"""Integrity constraints. Each returns the rows that break it: nothing is dropped, the caller fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.paths import ascii_lower
from driftloom.sources.stages import staged


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def case_collisions(paths: DataFrame) -> DataFrame:
    """Folded paths that several different paths share, and how many."""
    return paths.groupBy(ascii_lower(F.col("path")).alias("folded")).agg(F.countDistinct("path").alias("paths")).where("paths > 1")


def dangling(links: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Links whose target isn't there."""
    return links.join(targets.select(key), key, "left_anti")


def reference_counts(targets: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Targets that aren't linked exactly once, and how often: 0 is an orphan."""
    times = links.groupBy(key).agg(F.count("*").alias("times"))
    return targets.join(times, key, "left").withColumn("times", F.coalesce("times", F.lit(0))).where("times <> 1")


def first_fault(*rules: tuple[str, Column]) -> Column:
    """Code of the first rule that a row breaks, in the given order; null if it breaks none."""
    out = F.lit(None).cast("string")
    for code, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), code).otherwise(out)
    return out


def top_violation(violations: DataFrame, *order: str) -> DataFrame:
    """The violation to report first."""
    return violations.orderBy(*order).limit(1)


def passed(diagnostics: DataFrame, mode: str) -> DataFrame:
    """One row: diagnostics, warnings, passed. default: nothing but warnings; strict: nothing at all; warning: always."""
    count = diagnostics.agg(F.count("*").alias("diagnostics"), F.count_if("is_warning").alias("warnings"))
    rule = {"default": F.col("diagnostics") == F.col("warnings"), "strict": F.col("diagnostics") == 0, "warning": F.lit(True)}[mode]
    return count.withColumn("passed", rule)


def passed_by_mode(diagnostics: DataFrame) -> DataFrame:
    """mode, diagnostics, warnings, passed of all three modes, from one pass over the diagnostics."""
    count = diagnostics.agg(F.count("*").alias("diagnostics"), F.count_if("is_warning").alias("warnings"))
    rule = F.when(F.col("mode") == "default", F.col("diagnostics") == F.col("warnings")).when(F.col("mode") == "strict", F.col("diagnostics") == 0).otherwise(True)
    return count.select(F.explode(F.array(*[F.lit(m) for m in ("default", "strict", "warning")])).alias("mode"), "*").withColumn("passed", rule)


def over_quota(usage: DataFrame, limits: dict[str, int]) -> DataFrame:
    """resource, observed, quota, exceeded of a one-row frame of usage figures, each with a quota."""
    pairs = F.array(*[F.struct(F.lit(k).alias("resource"), F.col(k).cast("long").alias("observed"), F.lit(v).cast("long").alias("quota")) for k, v in limits.items()])
    return usage.select(F.explode(pairs).alias("_x")).select("_x.*").withColumn("exceeded", F.col("observed") > F.col("quota"))


def first_crossings(rows: DataFrame, ceilings: dict[str, int], *order: str, each: int = 100_000) -> DataFrame:
    """resource, the columns of ``order``, observed, quota: for each amount column with a ceiling, the first row in that order at which the running sum exceeds it.

    Amounts aren't negative; null counts as 0. A resource that stays below its ceiling has no row. ``order`` should
    tell all rows apart; of rows that it doesn't, any may be named. The running sum needs no window over all rows:
    rows are dealt by ranges of the order, each range adds up its amounts, and only the range in which a ceiling is
    crossed is scanned row by row, from the sum of the ranges before it. Totals are one row a range.
    """
    kept = rows.select(*order, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ceilings])
    parts = max(1, -(-rows.count() // each))
    dealt = staged(kept.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in ceilings])
    pairs = F.array(*[F.struct(F.lit(c).alias("resource"), F.col(c).alias("_sum"), F.lit(q).cast("long").alias("quota")) for c, q in ceilings.items()])
    upto = Window.partitionBy("resource").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ranges = totals.select("_part", F.explode(pairs).alias("_x")).select("_part", "_x.*").withColumn("_upto", F.sum("_sum").over(upto))
    crossed = ranges.where((F.col("_upto") > F.col("quota")) & (F.col("_upto") - F.col("_sum") <= F.col("quota"))).select("_part", "resource", "quota", (F.col("_upto") - F.col("_sum")).alias("_before"))
    amount = F.coalesce(*[F.when(F.col("resource") == c, F.col(c)) for c in ceilings])
    running = F.col("_before") + F.sum(amount).over(Window.partitionBy("resource").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    scanned = dealt.join(crossed, "_part").select("resource", *order, "quota", running.alias("observed")).where("observed > quota")
    first = scanned.groupBy("resource").agg(F.min(F.struct(F.col("observed"), *order)).alias("_x"), F.first("quota").alias("quota"))
    return first.select("resource", *[F.col(f"_x.{c}").alias(c) for c in order], "_x.observed", "quota")


def field_faults(items: DataFrame, rules: DataFrame) -> DataFrame:
    """item_id, field, fault of items (item_id, kind, fields array<string>) against rules (kind, field, presence: required or forbidden)."""
    met = items.join(rules, "kind").withColumn("_there", F.array_contains("fields", F.col("field")))
    fault = F.when((F.col("presence") == "required") & ~F.col("_there"), "missing_field").when((F.col("presence") == "forbidden") & F.col("_there"), "forbidden_field")
    return met.select("item_id", "field", fault.alias("fault")).where("fault IS NOT NULL")


def seed_faults(seeds: DataFrame, sketches: DataFrame) -> DataFrame:
    """Seeds (snippet_id, signature_type, contract_file, document_index, path, code) with the first thing that disagrees with their sketch."""
    facts = ("signature_type", "contract_file", "document_index", "path")
    known = sketches.select("snippet_id", F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in facts])
    joined = seeds.join(known, "snippet_id", "left")
    rules = [("unknown_sketch", F.col("_there").isNull()), *[(c, ~F.col(c).eqNullSafe(F.col(f"_{c}"))) for c in facts], ("empty_code", F.size("code") == 0)]
    return joined.select("snippet_id", first_fault(*rules).alias("fault")).where("fault IS NOT NULL")


def mode_conflicts(documents: DataFrame) -> DataFrame:
    """Crates that documents (contract_file, document_index, crate_id, mode, profile, root) describe in different ways, and how many ways."""
    ways = documents.groupBy("crate_id").agg(F.countDistinct(F.struct("mode", "profile", "root")).alias("ways"))
    return ways.where("ways > 1")
