"""Declared items of source files: a small scanner of item heads for a closed subset of Rust.

A file is scanned where it lies, one row at a time. Comments, strings and bodies are skipped by balanced
brackets. What the subset doesn't cover (unbalanced brackets, items it can't name) is a fault row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "path string, modules array<string>, pos int, kind string, name string, visibility string, declaration string, fault string"
#: Keywords of item heads and the kinds that they declare.
KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "type": "type_alias", "const": "constant", "static": "static", "mod": "module", "use": "reexport", "impl": "impl", "macro_rules": "macro", "extern": "extern_crate"}
SKIP = re.compile(r'//[^\n]*|/\*|extern\s*"[^"]*"|b?r(#*)".*?"\1|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\n][^\'\n]*)\'', re.S)
HEAD = re.compile(r"\s*(?:#!?\[[^\]]*\]\s*)*(pub(?:\s*\([^)]*\))?\s+)?((?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*)(fn|struct|enum|union|trait|type|const(?=\s+\w+\s*:)|static(?=\s+(?:mut\s+)?\w+\s*:)|mod|use|impl|macro_rules|extern(?=\s+crate\b))\b(?:\s*!)?\s*", re.S)
EDGE, REST = re.compile(r"/\*|\*/"), re.compile(r"\s*")


def blanked(text: str) -> str:
    """The text with comments as a space and literals without their contents; the ABI of an extern stays. ValueError if a comment doesn't end."""
    out, at = [], 0
    while m := SKIP.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "/*":
            depth = 1
            while depth:
                edge = EDGE.search(text, at)
                if not edge:
                    raise ValueError("unfinished comment")
                depth += 1 if edge[0] == "/*" else -1
                at = edge.end()
        out.append(" " if m[0].startswith("/") else m[0] if m[0].startswith("extern") else '""' if '"' in m[0] else "' '")
    return "".join([*out, text[at:]])


def items(text: str, modules: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(modules, kind, name, visibility, declaration without bodies of functions and modules, fault) in order."""
    at = 0
    while at < len(text):
        if REST.match(text, at).end() == len(text):
            return
        m = HEAD.match(text, at)
        if not m:
            yield (list(modules), None, None, None, None, f"unsupported at {at}")
            return
        end, depth, body = m.end(), 0, None
        while end < len(text):
            c = text[end]
            if c in "([{":
                body = end if c == "{" and depth == 0 and body is None else body
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth == 0 and c == "}" and m[3] not in ("use", "const", "static", "type"):
                    break
            elif c == ";" and depth == 0:
                break
            if depth < 0:
                break
            end += 1
        if end >= len(text) or depth > 0 or depth < 0:
            yield (list(modules), None, None, None, None, "unbalanced brackets")
            return
        head = text[m.end() : body if body is not None else end]
        if m[3] == "extern":
            head = head.removeprefix("crate").lstrip()
        named = re.match(r"mut\s+(\w+)|(\w+)", head)
        name = " ".join(head.split()) if m[3] in ("impl", "use") else (named[1] or named[2]) if named else None
        visibility = " ".join((m[1] or "private").split())
        keep = text[m.start(3) : end + 1] if m[3] in ("struct", "enum", "union", "use", "type") or body is None else text[m.start(2) : body if body is not None else end]
        yield (list(modules), KINDS[m[3]], name, visibility, " ".join(keep.split()), None if name else "unnamed item")
        if m[3] == "mod" and body is not None:
            yield from items(text[body + 1 : end], (*modules, name))
        if m[3] in ("impl", "trait") and body is not None and name:
            yield from members(text[body + 1 : end], modules, f"{KINDS[m[3]]} {name}", redundant=m[3] == "trait" or " for " in f" {name} ")
        at = end + 1


def members(text: str, modules: tuple[str, ...], owner: str, redundant: bool) -> Iterator[tuple]:
    """The constants, types, functions and macros of a body, as items named by their owner. redundant: the members' visibility is the owner's, and doesn't count."""
    for _, kind, name, visibility, declaration, fault in items(text):
        if fault is None and kind not in ("function", "constant", "type_alias", "macro"):
            fault = f"{kind} in {owner}"
        yield (list(modules), f"associated_{kind}", f"{owner}::{name}", "private" if redundant else visibility, declaration, fault)


def file_modules(path: str, modules: str) -> F.Column:
    """Names of the modules that a file's own item lies in: those of the file, by its place below the root, then the inner ones."""
    parts = F.split(F.regexp_replace(path, "(^|/)(lib|main|mod)\\.rs$|\\.rs$", ""), "/")
    return F.concat(F.array_remove(parts, ""), F.col(modules))


def declared(sources: DataFrame) -> DataFrame:
    """Rows of SHAPE for the items of (path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    found = list(items(blanked((content or b"").decode("utf-8"))))
                except (ValueError, RecursionError) as e:
                    fault = "invalid UTF-8" if isinstance(e, UnicodeDecodeError) else "too deep" if isinstance(e, RecursionError) else str(e)
                    found = [([], None, None, None, None, fault)]
                rows += [(path, m, k, *rest) for k, (m, *rest) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "modules", "pos", "kind", "name", "visibility", "declaration", "fault"])

    return sources.select("path", "content").mapInPandas(run, SHAPE)


def module_edges(found: DataFrame) -> DataFrame:
    """parent, candidates: files that a ``mod name;`` of each file may lead to."""
    outer = found.where((F.col("kind") == "module") & F.endswith("declaration", F.lit(";")))
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "$1")
    stem = F.regexp_replace("path", "\\.rs$", "/")
    base = F.when(F.col("path").rlike("(^|/)(lib|main|mod)\\.rs$"), folder).otherwise(stem)
    inner = F.concat(base, F.array_join(F.transform("modules", lambda m: F.concat(m, F.lit("/"))), ""), F.col("name"))
    return outer.select(F.col("path").alias("parent"), F.array(F.concat(inner, F.lit(".rs")), F.concat(inner, F.lit("/mod.rs"))).alias("candidates"))


def module_files(found: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges parent, child; faults parent, candidates, fault) of declared modules against the files that there are."""
    edges = module_edges(found)
    reached = edges.select("parent", "candidates", F.explode("candidates").alias("path")).join(sources.select("path"), "path", "left_semi")
    per = edges.join(reached.groupBy("parent", "candidates").agg(F.count("*").alias("_n")), ["parent", "candidates"], "left")
    faults = per.where(F.coalesce("_n", F.lit(0)) != 1).select("parent", "candidates", F.when(F.col("_n").isNull(), "unlisted_target").otherwise("ambiguous_target").alias("fault"))
    return reached.select("parent", F.col("path").alias("child")), faults
