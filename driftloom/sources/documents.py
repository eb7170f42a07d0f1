"""Contract documents: strict YAML to rows.

YAML streams are parsed where they lie, one file a row. Duplicate keys, merge keys, aliases, unknown root
fields, empty documents and wrong shapes become a fault in that document's row, never a dropped row.
Only true and false are booleans; yes, no, on and off are strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.contents import bytes_of, lines, text_of
from driftloom.functions.paths import root_documents

#: Fields of a document, and of an entry below a label.
ROOT_FIELDS = ("contract_version", "root", "files", "extraction", "signatures", "sketches")
SKETCH_FIELDS = ("id", "file", "linked_signature", "signature_type", "normalization", "occurrence", "code")
OCCURRENCES = ("at_least_one", "exactly_one")
#: Most documents, nodes and levels of one stream.
DOCUMENTS, NODES, DEPTH = 1024, 1_000_000, 128
SHAPE = (
    "contract_file string, document_index int, version int, root string, files array<string>, "
    "signatures array<struct<label:string, sketch:string, type:string, file:string>>, "
    "sketches array<struct<label:string, id:string, file:string, linked_signature:string, signature_type:string, occurrence:string, code:string>>, fault string"
)


def parse(content: bytes) -> list[dict]:
    """The documents of one stream, as dicts with the keys of SHAPE but the file."""
    import yaml

    class Strict(yaml.SafeLoader):
        nodes, depth = 0, 0

        def compose_node(self, parent, index):
            if self.check_event(yaml.events.AliasEvent):
                raise ValueError("alias")
            self.nodes, self.depth = self.nodes + 1, self.depth + 1
            if self.nodes > NODES or self.depth > DEPTH:
                raise ValueError("quota")
            node = super().compose_node(parent, index)
            self.depth -= 1
            return node

        def construct_mapping(self, node, deep=False):
            if not all(isinstance(k, yaml.ScalarNode) for k, _ in node.value):
                raise ValueError("shape")
            keys = [k.value for k, _ in node.value]
            if "<<" in keys:
                raise ValueError("merge_key")
            if len(keys) != len(set(keys)):
                raise ValueError("duplicate_key")
            return super().construct_mapping(node, deep=True)

    Strict.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:merge")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    import re

    Strict.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|false)$"), list("tf"))

    def typed(value, kind):
        if value is not None and (not isinstance(value, kind) or kind is int and isinstance(value, bool)):
            raise ValueError("shape")
        return value

    def labelled(items, known):
        for item in typed(items, list) or []:
            if not isinstance(item, dict) or len(item) != 1:
                raise ValueError("one_entry_map")
            (label, body), = item.items()
            if known and set(typed(body, dict) or ()) - set(known):
                raise ValueError("unknown_field")
            if (typed(body, dict) or {}).get("occurrence") not in (None, *OCCURRENCES):
                raise ValueError("shape")
            yield typed(label, str), body or {}

    out: list[dict] = []
    blank = {"version": None, "root": None, "files": None, "signatures": None, "sketches": None}
    try:
        for doc in yaml.load_all(content.decode("utf-8"), Strict):
            index = len(out)
            if index >= DOCUMENTS:
                raise ValueError("quota")
            try:
                if not isinstance(doc, dict):
                    raise ValueError("empty_document")
                if set(doc) - set(ROOT_FIELDS):
                    raise ValueError("unknown_field")
                text = lambda b, k: typed(b.get(k), str)
                version, files = typed(doc.get("contract_version"), int), typed(doc.get("files"), list) or []
                out.append({
                    "document_index": index, "version": version, "root": text(doc, "root"), "files": [text({"": x}, "") for x in files],
                    "signatures": [{"label": label, **{k: text(b, k) for k in ("sketch", "type", "file")}} for label, b in labelled(doc.get("signatures"), None)],
                    "sketches": [{"label": label, **{k: text(b, k) for k in ("id", "file", "linked_signature", "signature_type", "occurrence", "code")}} for label, b in labelled(doc.get("sketches"), SKETCH_FIELDS)],
                    "fault": None if version == 2 else "version",
                })
            except (ValueError, TypeError, AttributeError) as e:
                out.append({"document_index": index, **blank, "fault": str(e) if str(e) in ("empty_document", "unknown_field", "one_entry_map") else "shape"})
    except (yaml.YAMLError, UnicodeDecodeError, ValueError, RecursionError) as e:
        out.append({"document_index": len(out), **blank, "fault": str(e) if str(e) in ("alias", "merge_key", "duplicate_key", "quota", "shape") else "syntax"})
    return out or [{"document_index": 0, **blank, "fault": "empty_document"}]


def documents(files: DataFrame) -> DataFrame:
    """Rows of SHAPE for each document of each root-level YAML file of (path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["contract_file", "document_index", "version", "root", "files", "signatures", "sketches", "fault"]
        for b in batches:
            rows = [{"contract_file": p, **d} for p, c in zip(b.path, b.content, strict=True) for d in parse(c or b"")]
            yield pd.DataFrame(rows, columns=names)

    return files.where(root_documents(F.col("path"))).select("path", "content").mapInPandas(run, SHAPE)


def sketch_rows(parsed: DataFrame) -> DataFrame:
    """snippet_id, path, occurrence, code lines and where each sketch is written; code is one character for each byte."""
    each = parsed.where("fault IS NULL").select("contract_file", "document_index", F.explode("sketches").alias("s"))
    code = lines(text_of(F.encode(F.coalesce("s.code", F.lit("")), "UTF-8")))
    return each.select(F.col("s.id").alias("snippet_id"), F.col("s.file").alias("path"), F.coalesce("s.occurrence", F.lit("at_least_one")).alias("occurrence"), code.alias("code"), F.col("s.linked_signature").alias("linked_signature"), F.col("s.signature_type").alias("signature_type"), "contract_file", "document_index")


def signature_rows(parsed: DataFrame) -> DataFrame:
    """label, sketch, signature_type, file and where each signature is written."""
    each = parsed.where("fault IS NULL").select("contract_file", "document_index", F.explode("signatures").alias("s"))
    return each.select(F.col("s.label").alias("label"), F.col("s.sketch").alias("sketch"), F.col("s.type").alias("signature_type"), F.coalesce("s.file", F.lit(None).cast("string")).alias("file"), "contract_file", "document_index")


def source_lines(files: DataFrame) -> DataFrame:
    """path, lines of (path, content)."""
    return files.select("path", lines(text_of(F.col("content"))).alias("lines"))


def line_bytes(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.transform(column, bytes_of))
