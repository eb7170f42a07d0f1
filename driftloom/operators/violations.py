"""Rules of contract documents. Each gives the rows that break it; a check refuses to run while there is any.

documents(contract_file, document_index, root, files array<string>, fault);
sketches(snippet_id, contract_file, document_index, path, code array<string>, linked_signature, signature_type);
signatures(label, contract_file, document_index, sketch, signature_type, file). Nulls in a name break the rule of that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.paths import id_fault
from driftloom.operators.constraints import duplicates
from driftloom.sources.stages import staged

PLACE = ("contract_file", "document_index")
#: All codes, in the order in which they are reported.
CODES = (
    "syntax", "quota", "alias", "merge_key", "duplicate_key", "empty_document", "unknown_field", "one_entry_map", "shape", "version",
    "blank_root", "duplicate_file", "invalid_id", "duplicate_sketch", "unlisted_file", "empty_code", "duplicate_label", "unlisted_signature_file", "not_rust",
    "dangling_link", "orphan_sketch", "file_mismatch", "label_mismatch", "type_mismatch",
)


def row(rows: DataFrame, code, name: str | None) -> DataFrame:
    return rows.select((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"), *PLACE)


def each(rows: DataFrame, name: str | None, *rules: tuple[str | Column, Column]) -> DataFrame:
    """A row for each rule (code, broken) that a row breaks by itself, in one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(at, F.lit(code) if isinstance(code, str) else code) for code, at in rules]))
    return row(rows.withColumn("_codes", broken).where(F.size("_codes") > 0).withColumn("_code", F.explode("_codes")), F.col("_code"), name)


def of_documents(documents: DataFrame) -> DataFrame:
    fine, root = F.col("fault").isNull(), F.col("root")
    return each(documents, None, (F.col("fault"), ~fine), ("blank_root", fine & (root.isNull() | (F.trim(root) == ""))), ("duplicate_file", fine & (F.size("files") != F.size(F.array_distinct("files")))))


def listed(documents: DataFrame) -> DataFrame:
    """Files of documents; those of documents with one name may come twice."""
    return documents.where("fault IS NULL").select(*PLACE, F.explode(F.array_distinct("files")).alias("path"))


def twice(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key another row has too. Only hashes of all keys are shuffled, then the rows of hashes that came twice."""
    at = F.xxhash64(key).alias("_at")
    again = staged(rows.groupBy(at).agg(F.count("*").alias("_n")).where("_n > 1").select("_at"))
    near = rows.withColumn("_at", at).join(again, "_at", "left_semi").drop("_at")
    return near.join(duplicates(near, key).select(key), key, "left_semi")


def unlisted(documents: DataFrame, sketches: DataFrame, signatures: DataFrame | None) -> DataFrame:
    """Sketches and signatures whose file their document doesn't list, met with the lists in one join."""
    names = lambda df, name, path, code: df.select(*PLACE, F.col(path).alias("path"), F.col(name).cast("string").alias("name"), F.lit(code).alias("_code"))
    rows = names(sketches, "snippet_id", "path", "unlisted_file")
    if signatures is not None:
        rows = rows.unionByName(names(signatures, "label", "file", "unlisted_signature_file"))
    return row(rows.join(listed(documents), [*PLACE, "path"], "left_anti"), F.col("_code"), "name")


def of_sketches(sketches: DataFrame) -> list[DataFrame]:
    return [
        each(sketches, "snippet_id", ("invalid_id", id_fault(F.col("snippet_id").cast("string")).isNotNull()), ("empty_code", F.size("code") == 0)),
        row(twice(sketches.select("snippet_id", *PLACE), "snippet_id"), "duplicate_sketch", "snippet_id"),
    ]


def of_signatures(signatures: DataFrame) -> list[DataFrame]:
    keys = [*PLACE, "label"]
    counted = signatures.select(*keys).dropna().withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return [
        each(signatures, "label", ("not_rust", F.col("file").isNull() | ~F.endswith("file", F.lit(".rs")))),
        row(counted.where("_n > 1"), "duplicate_label", "label"),
    ]


def of_links(sketches: DataFrame, signatures: DataFrame) -> DataFrame:
    """A signature names its sketch, which names the signature back: in one document, of one file and type; a sketch that no signature names is an orphan. One full join finds all."""
    keys = [*PLACE, "snippet_id"]
    links = signatures.where("sketch IS NOT NULL").select(*PLACE, F.col("sketch").alias("snippet_id"), "label", F.col("file").alias("_file"), F.col("signature_type").alias("_type"), F.lit(True).alias("_named"))
    both = links.join(sketches.select(*keys, "path", "linked_signature", "signature_type", F.lit(True).alias("_there")), keys, "full")
    fault = F.when(F.col("_there").isNull(), "dangling_link").when(F.col("_named").isNull(), "orphan_sketch")
    fault = fault.when(~F.col("_file").eqNullSafe(F.col("path")), "file_mismatch").when(~F.col("label").eqNullSafe(F.col("linked_signature")), "label_mismatch").when(~F.col("_type").eqNullSafe(F.col("signature_type")), "type_mismatch")
    name = F.when(F.col("_there").isNull(), F.col("label")).otherwise(F.col("snippet_id").cast("string"))
    return row(both.withColumns({"_fault": fault, "_name": name}).where("_fault IS NOT NULL"), F.col("_fault"), "_name")


def violations(documents: DataFrame, sketches: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """code, name, contract_file, document_index of every broken rule; links are checked where signatures are given."""
    parts = [of_documents(documents), *of_sketches(sketches), unlisted(documents, sketches, signatures)]
    if signatures is not None:
        parts += [*of_signatures(signatures), of_links(sketches, signatures)]
    return reduce(DataFrame.unionByName, parts)


def ranked(broken: DataFrame) -> DataFrame:
    """Violations with ``rank``, the place of their code in the order of reports; the smallest is reported first."""
    known = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("code"))
    return broken.withColumn("rank", F.when(known > 0, known).otherwise(len(CODES) + 1).cast("long"))


def first_violation(broken: DataFrame) -> DataFrame:
    """The violation that each document reports."""
    order = Window.partitionBy(*PLACE).orderBy("rank", F.col("name").asc_nulls_first())
    return ranked(broken).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def root_overlaps(roots: DataFrame) -> DataFrame:
    """outer, inner: pairs of roots (name, path) of which one is the other, or lies inside it. Each path meets its own ancestors by an equi join."""
    parts = F.split("path", "/")
    above = roots.select(F.col("name").alias("inner"), F.col("path").alias("_own"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path"))
    both = above.join(roots.select(F.col("name").alias("outer"), "path"), "path").where(F.col("inner") != F.col("outer"))
    return both.where((F.col("_own") != F.col("path")) | (F.col("outer") < F.col("inner"))).select("outer", "inner")


def allowlist(documents: DataFrame) -> DataFrame:
    """path: the union of the files of all documents without a fault."""
    return documents.where("fault IS NULL").select(F.explode("files").alias("path")).distinct()


def equal_documents(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: equal, whether two sets of rows agree with multiplicity, in whatever order."""
    count = lambda df, n: df.groupBy(*df.columns).agg(F.count("*").alias("_n")).select(*df.columns, (F.lit(n) * F.col("_n")).alias("_n"))
    apart = count(left, 1).unionByName(count(right, -1)).groupBy(*left.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return apart.agg((F.count("*") == 0).alias("equal"), F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("apart"))
