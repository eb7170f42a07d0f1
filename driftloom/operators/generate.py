"""Generation: labels for items, and what a refresh keeps, adds and drops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def base_label(name: str, kind: str) -> F.Column:
    clean = lambda c: F.regexp_replace(F.col(c), "[^A-Za-z0-9_]", "_")
    return F.concat_ws("_", clean(name), F.col(kind))


def planned_labels(items: DataFrame, existing: DataFrame) -> DataFrame:
    """document, item_id, label for items (document, item_id, crate, modules array<string>, name, kind, pos).

    An item keeps its label of ``existing`` (document, item_id, label). New ones take, in order of pos, the first
    free of <name>_<kind>, <crate>_<modules>_<name>_<kind>, and that with _2, _3, ... Labels of the existing
    document stay reserved, even of items that are gone. Each document is planned alone.
    """
    old = existing.select("document", F.col("item_id").alias("_old"), F.col("label").alias("_label"))
    qualified = F.concat_ws("_", F.regexp_replace("crate", "[^A-Za-z0-9_]", "_"), F.when(F.size("modules") > 0, F.array_join("modules", "_")), base_label("name", "kind"))
    new = items.select("document", "item_id", "pos", base_label("name", "kind").alias("_base"), qualified.alias("_full"))

    def plan(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        kept, taken = dict(zip(held._old, held._label, strict=True)), set(held._label)
        out = []
        for r in rows.sort_values(["pos", "item_id"]).itertuples():
            label = kept.get(r.item_id)
            if label is None:
                n, label = 2, r._4 if r._4 not in taken else r._5
                while label in taken:
                    label, n = f"{r._5}_{n}", n + 1
                taken.add(label)
            out.append((r.document, r.item_id, label))
        return pd.DataFrame(out, columns=["document", "item_id", "label"])

    return new.groupBy("document").cogroup(old.groupBy("document")).applyInPandas(plan, "document string, item_id string, label string")


def refresh(items: DataFrame, existing: DataFrame) -> DataFrame:
    """document, item_id, state: kept, added or stale, of items against an existing document's entries."""
    both = items.select("document", "item_id", F.lit(True).alias("_now")).join(existing.select("document", "item_id", F.lit(True).alias("_then")), ["document", "item_id"], "full_outer")
    return both.select("document", "item_id", F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "stale").otherwise("kept").alias("state"))


def orphaned(stale: DataFrame, sketches: DataFrame) -> DataFrame:
    """Sketches linked to a stale item: an error when only signatures are generated, dropped with it when all is."""
    return sketches.join(stale.where("state = 'stale'").select("document", "item_id"), ["document", "item_id"], "left_semi")


def crate_roots(paths: DataFrame) -> DataFrame:
    """The conventional root, if there is exactly one: path, kind."""
    found = paths.where(F.col("path").isin("lib.rs", "main.rs")).agg(F.collect_list("path").alias("_p"))
    return found.where(F.size("_p") == 1).select(F.col("_p")[0].alias("path"), F.when(F.col("_p")[0] == "lib.rs", "library").otherwise("binary").alias("kind"))
