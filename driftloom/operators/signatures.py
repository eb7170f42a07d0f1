"""Signatures as rows: scoped names, canonical visibility, encoded context, counts and order of what a check says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped_id(file: Column, index: Column, name: Column) -> Column:
    """An item's name inside one document of a stream; the unscoped name stays its meaning."""
    return F.concat(file, F.lit("::document:"), index.cast("string"), F.lit("::"), name)


def text_slice(text: Column, first: Column, last: Column) -> Column:
    """Bytes first (from 0) to last, exclusive, of contents with one character for each byte; null beyond the end."""
    return F.when((first >= 0) & (first <= last) & (last <= F.length(text)), F.substring(text, first + 1, last - first))


def canonical_visibility(module: Column, target: Column) -> Column:
    """crate, private or module:<path>, of an item in ``module`` that is visible in ``target`` (both arrays of names); outside:<path> is an error, since only modules above are allowed."""
    inside = F.slice(module, 1, F.size(target)) == target
    path = F.array_join(target, "::")
    return F.when(F.size(target) == 0, "crate").when(target == module, "private").when((F.size(target) < F.size(module)) & inside, F.concat(F.lit("module:"), path)).otherwise(F.concat(F.lit("outside:"), path))


def extraction_context(version: Column, files: Column, mode: Column, crate: Column) -> Column:
    """JSON of what a document's extraction depends on; the order of files, and repeated ones, don't matter."""
    return F.to_json(F.struct(version.alias("version"), F.array_sort(F.array_distinct(files)).alias("files"), mode.alias("extraction"), crate.alias("crate_id")))


def metadata_context(root: Column, sketch: Column, kind: Column) -> Column:
    return F.to_json(F.struct(root.alias("root"), sketch.alias("sketch"), kind.alias("type")), {"ignoreNullFields": "false"})


def group_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: how many groups each side of a signature check has."""
    one = lambda df, name: df.agg(F.countDistinct("group_id").alias(name)).withColumn("_one", F.lit(1))
    return one(expected, "expected_groups").join(one(actual, "actual_groups"), "_one").drop("_one")


def all_diagnostics(compared: DataFrame, warnings: DataFrame) -> DataFrame:
    """section, key, kind, expected_shape, actual_shape: differences by key, then each distinct warning (message) once."""
    first = compared.select(F.lit(0).alias("section"), "key", "kind", "expected_shape", "actual_shape")
    nothing = F.lit(None).cast("string")
    then = warnings.select("message").distinct().select(F.lit(1).alias("section"), F.col("message").alias("key"), F.lit("warning").alias("kind"), nothing.alias("expected_shape"), nothing.alias("actual_shape"))
    return first.unionByName(then)


def ordered_diagnostics(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy("section", "key", "kind")


def ordered_seeds(seeds: DataFrame) -> DataFrame:
    return seeds.orderBy("contract_file", "document_index", "snippet_id")


def generation_counts(documents: DataFrame, entries: DataFrame, sketches: DataFrame) -> DataFrame:
    """One row of what a generation did: documents (contract_file, document_index, before, after: bytes or null), entries (changed), sketches (contract_file, document_index, linked, changed)."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    d = documents.agg(F.count("*").alias("documents"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("byte_changed"))
    e = entries.agg(F.count("*").alias("signatures"), F.count_if("changed").alias("semantic_changed"))
    s = sketches.agg(F.count_if(~F.col("linked")).alias("preserved_sketches"), F.count_if("linked").alias("linked_sketches"), F.count_if("changed").alias("changed_sketches"), F.countDistinct(F.when(F.col("changed"), F.struct("contract_file", "document_index"))).alias("changed_documents"))
    return one(d).join(one(e), "_one").join(one(s), "_one").drop("_one")


def rewritten(documents: DataFrame) -> DataFrame:
    """Documents (path, original, fresh, meaning_before, meaning_after): content is the original where the meaning is the same, or where nothing fresh was made for the path."""
    same = F.col("fresh").isNull() | F.col("meaning_before").eqNullSafe(F.col("meaning_after"))
    return documents.select("path", F.when(same, F.col("original")).otherwise(F.col("fresh")).alias("content"), (~same).alias("changed"))


def free_name(taken: DataFrame, stem: str, extension: str) -> DataFrame:
    """One row: the first of stem.ext, stem-1.ext, stem-2.ext, ... that isn't among taken (path)."""
    number = F.regexp_extract("path", f"^\\Q{stem}\\E-([1-9][0-9]*)\\Q{extension}\\E$", 1)
    used = taken.select(F.when(F.col("path") == f"{stem}{extension}", 0).when(number != "", number.try_cast("int")).alias("_n")).where("_n IS NOT NULL").distinct()
    following = used.select((F.col("_n") + 1).alias("_n")).unionByName(taken.sparkSession.range(1).select(F.lit(0).alias("_n")))
    first = following.join(used, "_n", "left_anti").agg(F.min("_n").alias("_n"))
    return first.select(F.when(F.col("_n") == 0, f"{stem}{extension}").otherwise(F.concat(F.lit(f"{stem}-"), "_n", F.lit(extension))).alias("path"))
