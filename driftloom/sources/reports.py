"""Reports as one JSON row with fixed field order, and ordered lines of a diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_report(counts: DataFrame, passed: DataFrame, diagnostics: DataFrame, most: int = 10_000) -> DataFrame:
    """One row ``report``: passed, counts, diagnostics in order. Diagnostics beyond ``most`` fail the report instead of being cut."""
    cols = [c for c in ("snippet_id", "contract_file", "document_index", "path", "kind", "rank") if c in diagnostics.columns]
    return as_json(passed.select("passed"), counts, listed(diagnostics.select(cols), most))


def listed(diagnostics: DataFrame, most: int = 10_000) -> DataFrame:
    """One row: diagnostics, in order. At most one more than ``most`` are gathered; then it is an error."""
    few = diagnostics.limit(most + 1).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct(diagnostics.columns))).alias("_d"))
    return few.select(F.when(F.col("_n") > most, F.raise_error(F.lit("too many diagnostics"))).otherwise(F.col("_d")).alias("diagnostics"))


def as_json(passed: DataFrame, counts: DataFrame, diagnostics: DataFrame, *more: DataFrame) -> DataFrame:
    """One row ``report`` of one-row frames: passed, further columns, counts as an object, diagnostics."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(passed).join(one(counts.select(F.struct(*counts.columns).alias("counts"))), "_one").join(one(diagnostics), "_one")
    for x in more:
        joined = joined.join(one(x), "_one")
    return joined.select(F.to_json(F.struct("passed", *[c for x in more for c in x.columns], "counts", "diagnostics")).alias("report"))


def signature_report(counts: DataFrame, passed: DataFrame, diagnostics: DataFrame, shape: DataFrame, version: str = "driftloom:v2", most: int = 10_000) -> DataFrame:
    """One row ``report``: passed, source_shape_digest, digest_version, counts, diagnostics (section, key, kind, expected_shape, actual_shape) in their order."""
    digest = shape.select(F.col("shape_digest").alias("source_shape_digest"), F.lit(version).alias("digest_version"))
    return as_json(passed.select("passed"), counts, listed(diagnostics.select("section", "key", "kind", "expected_shape", "actual_shape"), most), digest)


def combined_report(signatures: DataFrame, sketches: DataFrame) -> DataFrame:
    """One row ``report`` of two reports: passed if both did, then both as they are."""
    both = signatures.select(F.col("report").alias("_a"), F.lit(1).alias("_one")).join(sketches.select(F.col("report").alias("_b"), F.lit(1).alias("_one")), "_one")
    ok = lambda c: F.get_json_object(c, "$.passed") == "true"
    return both.select(F.concat(F.lit('{"passed":'), (ok("_a") & ok("_b")).cast("string"), F.lit(',"signatures":'), "_a", F.lit(',"sketches":'), "_b", F.lit("}")).alias("report"))


def format_of(path: str) -> str:
    """yaml or json, by a report's file name in any case; ValueError for any other."""
    end = path.lower().rpartition(".")[2]
    if end not in ("yml", "yaml", "json"):
        raise ValueError(f"reports are .yml, .yaml or .json files, not {path}")
    return "json" if end == "json" else "yaml"


def summary(counts: DataFrame, label: str) -> DataFrame:
    """One row ``line``: label and all counts of a one-row frame, for people."""
    return counts.select(F.concat(F.lit(f"{label}: "), F.concat_ws(", ", *[F.concat(F.col(c).cast("string"), F.lit(f" {c.replace('_', ' ')}")) for c in counts.columns])).alias("line"))


def diff_lines(signatures: DataFrame, snippets: DataFrame) -> DataFrame:
    """section, seq, line of a printed diff: signature entries by label, then snippet entries by id."""
    first = signatures.select(F.lit(0).alias("section"), F.struct(F.col("label").alias("name"), F.col("rn").cast("long").alias("n")).alias("seq"), F.concat_ws(" ", "change", "label", F.array_join("categories", ",")).alias("line"))
    then = snippets.select(F.lit(1).alias("section"), F.struct(F.col("snippet_id").alias("name"), F.lit(0).cast("long").alias("n")).alias("seq"), F.concat_ws(" ", "change", "snippet_id", "fields").alias("line"))
    return first.unionByName(then).orderBy("section", "seq")
