"""Lookups between items: owners, links to declared items, names through imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.graph import jumps
from driftloom.sources.stages import staged


def owned(blocks: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks joined with their owners by owner_id, blocks whose owner isn't declared)."""
    return blocks.join(owners, "owner_id"), blocks.join(owners.select("owner_id"), "owner_id", "left_anti")


def linked(links: DataFrame, items: DataFrame) -> DataFrame:
    """Links (link_id, item_id, file) with a fault: missing_item, file_mismatch or null."""
    known = items.select("item_id", F.col("file").alias("_file"), F.lit(True).alias("_there"))
    fault = F.when(F.col("_there").isNull(), "missing_item").when(F.col("file") != F.col("_file"), "file_mismatch")
    return links.join(known, "item_id", "left").withColumn("fault", fault).drop("_file", "_there")


def resolve(names: DataFrame, declared: DataFrame, imports: DataFrame) -> DataFrame:
    """names (module, name) with target (module of the declaration) or a fault: unresolved, ambiguous or import_cycle.

    A name is declared in its module, or comes from the module that an import (module, name, source, source_name)
    leads to, and so on. A declaration wins over an import. Where one import leads on, chains of any length are
    walked by doubled steps (``graph.jumps``); a round of joins is needed only for each place in a row where
    several imports lead on. A walk ends where it comes back to such a place.
    """
    place = lambda module, name: F.struct(F.col(module).alias("module"), F.col(name).alias("name"))
    asked = staged(names.select("module", "name").distinct())
    places = staged(declared.select(place("module", "name").alias("at")).distinct())
    leads = imports.select(place("module", "name").alias("at"), place("source", "source_name").alias("to")).distinct().join(places, "at", "left_anti")
    leads = staged(leads.join(leads.groupBy("at").agg((F.count("*") > 1).alias("_forks")), "at"))
    ways = staged(jumps(leads.where("NOT _forks").select("at", "to")).select("at", "end", (F.col("kind") != "ended").alias("_endless")))
    forks = leads.where("_forks").select(F.col("at").alias("_from"), F.col("to").alias("_to"))

    def led(rows: DataFrame) -> DataFrame:
        """Rows at the ends of their chains."""
        out = rows.join(ways, "at", "left").withColumn("at", F.coalesce("end", "at")).withColumn("_cycle", F.coalesce("_endless", F.lit(False)))
        return staged(out.drop("end", "_endless"))

    step = led(asked.withColumn("at", place("module", "name")).withColumn("_seen", F.array().cast("array<struct<module: string, name: string>>")))
    ends = [asked.where("false").select("module", "name", F.lit(None).cast("string").alias("_target"), F.lit(False).alias("_cycle"))]
    while True:
        back = F.array_contains("_seen", F.col("at"))
        ends.append(step.join(places, "at", "left_semi").where("NOT _cycle").select("module", "name", F.concat_ws("::", "at.module", "at.name").alias("_target"), F.lit(False).alias("_cycle")))
        ends.append(step.where(F.col("_cycle") | back).select("module", "name", F.lit(None).cast("string").alias("_target"), F.lit(True).alias("_cycle")))
        onward = step.where(~F.col("_cycle") & ~back).join(forks, F.col("at") == F.col("_from"))
        step = led(onward.select("module", "name", F.col("_to").alias("at"), F.array_append("_seen", F.col("at")).alias("_seen")))
        if step.isEmpty():
            break
    per = asked.join(reduce(DataFrame.unionByName, ends), ["module", "name"], "left").groupBy("module", "name").agg(F.collect_set("_target").alias("_t"), F.coalesce(F.bool_or("_cycle"), F.lit(False)).alias("_c"))
    fault = F.when(F.size("_t") > 1, "ambiguous").when((F.size("_t") == 0) & F.col("_c"), "import_cycle").when(F.size("_t") == 0, "unresolved")
    return per.select("module", "name", F.when(F.size("_t") == 1, F.col("_t")[0]).alias("target"), fault.alias("fault"))
