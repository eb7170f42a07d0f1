"""Whole checks and diffs: from files to diagnostics, counts and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.digests import entry_digest
from driftloom.functions.paths import item_id
from driftloom.operators import constraints, inventory, items, matching
from driftloom.operators.violations import violations
from driftloom.sources import documents, reports
from driftloom.sources.stages import staged


class Refused(ValueError):
    """Documents or sources break rules; ``violations`` is a DataFrame of them."""

    def __init__(self, broken: DataFrame) -> None:
        worst = broken.limit(1).collect()[0]
        super().__init__(f"{worst.code} in {worst.contract_file}")
        self.violations = broken


def contract_violations(parsed: DataFrame) -> DataFrame:
    """code, name, contract_file, document_index of every rule that parsed documents break."""
    signatures = documents.signature_rows(parsed)
    return violations(parsed, documents.sketch_rows(parsed), signatures)


def check_sketches(sources: DataFrame, contracts: DataFrame, mode: str = "default") -> tuple[DataFrame, DataFrame]:
    """(diagnostics, one-row JSON report) of sources and contracts, both (path, content). Raises Refused while a document breaks a rule."""
    parsed = staged(documents.documents(contracts))
    broken = staged(contract_violations(parsed))
    if not broken.isEmpty():
        raise Refused(broken)
    sketches = documents.sketch_rows(parsed)
    found = matching.matched(sketches, documents.source_lines(matching.referenced(sources, sketches)))
    problems = matching.diagnostics(found)
    passed = constraints.passed(problems.withColumn("is_warning", F.lit(False)), mode)
    return problems, reports.check_report(matching.counts(found), passed, problems)


def inventory_of(sources: DataFrame, crate: str = "main") -> DataFrame:
    """entry_id, semantic_id, group_id, digest of the declared items of sources (path, content). Raises Refused if a file can't be read as items.

    An item is named by its modules, those of its file among them, not by the file's place in folders.
    """
    found = staged(items.declared(sources))
    broken = found.where("fault IS NOT NULL").select(F.col("fault").alias("code"), F.lit(None).cast("string").alias("name"), F.col("path").alias("contract_file"), F.lit(None).cast("int").alias("document_index"))
    if not broken.isEmpty():
        raise Refused(broken)
    named = matching.numbered(found.withColumn("_modules", items.file_modules("path", "modules")), ["_modules", "kind", "name"], ["path", "pos"])
    one = item_id(F.lit(crate), F.col("_modules"), F.col("kind"), F.col("name"), F.col("occurrence"))
    canonical = F.to_json(F.struct("kind", "name", "visibility", "declaration"))
    return named.select(one.alias("entry_id"), one.alias("semantic_id"), one.alias("group_id"), entry_digest(canonical).alias("digest"))


def check_signatures(expected: DataFrame, sources: DataFrame) -> DataFrame:
    """Missing, extra and mismatched groups of an expected inventory against sources."""
    return inventory.compared(expected, staged(inventory_of(sources)))
