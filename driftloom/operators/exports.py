"""Names that modules make visible through re-exports, single ones and whole modules (globs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.sources.stages import staged

KEYS = ["module", "name"]
#: Tables of changed rows that are read side by side before they are made one; modules that are broadcast at most; rows that a task of the last join makes.
PARTS, BROADCAST, TASK_ROWS = 16, 1_000_000, 2_000_000


def fixpoint(start: DataFrame, keys: list[str], step) -> DataFrame:
    """keys, low, high: the least and greatest values of start and of all that step makes of changed rows, until none change.

    Only changed rows are written in a round; those of all rounds are read as the known ones.
    """
    wide = lambda df, was: df.select(*keys, *[F.col(c if own else "_null").alias(n) for own, x in ((was, ""), (not was, "_")) for c, n in (("low", f"{x}low"), ("high", f"{x}high"))])
    empty = lambda df, was: wide(df.withColumn("_null", F.lit(None).cast(dict(df.dtypes)["low"])), was)
    fresh = staged(start)
    known = [fresh]
    while True:
        both = reduce(DataFrame.unionByName, [*(empty(x, True) for x in known), empty(step(fresh), False)])
        both = both.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        new = F.col("_low").isNotNull() & (F.col("low").isNull() | (F.col("_low") < F.col("low")) | (F.col("_high") > F.col("high")))
        fresh = staged(both.where(new).select(*keys, F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high")))
        if fresh.isEmpty():
            return together(known, keys)
        known = [*known, fresh] if len(known) < PARTS else [staged(together([*known, fresh], keys))]


def together(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def expanded(declared: DataFrame, exports: DataFrame) -> DataFrame:
    """module, name, item, explicit, fault of every name that is visible in a module.

    declared: module, name, item. exports: module, name, source, source_name, glob; a glob takes all visible
    names of its source, and its name and source_name don't count. A name that is declared or exported by
    itself hides all that globs bring under it, even where it leads nowhere (fault unresolved). A name that
    stands for different items is a conflict (item null), and so is each name that is taken from it.

    Fixpoints over changed rows only. Modules that have names of their own, or of which single names are taken,
    are walked name by name; from a module that has none all names pass, so of these it is only found which of the
    former they lead to, and modules that lead to the same ones see the same names, which are made once. The
    rows of such modules, most of the result, aren't made before the last join. Circles of modules end by
    themselves. A name is one row however many items it may stand for: two that differ prove the conflict.
    """
    single = staged(exports.where("NOT glob").where("name IS NOT NULL").select(*KEYS, "source", "source_name").distinct())
    globs = staged(exports.where("glob AND module IS NOT NULL AND source IS NOT NULL").select("module", "source").distinct())
    fixed = staged(declared.select(*KEYS).unionByName(single.select(*KEYS)).distinct())
    core = staged(fixed.select("module").unionByName(single.select(F.col("source").alias("module"))).distinct())
    hop = globs.join(core.select(F.col("module").alias("source")), "source", "left_semi")
    plain = globs.join(core.select(F.col("module").alias("source")), "source", "left_anti")
    mark = [F.lit(0).alias("low"), F.lit(0).alias("high")]
    reach = fixpoint(hop.select("module", F.col("source").alias("core"), *mark), ["module", "core"], lambda x: x.withColumnRenamed("module", "source").join(plain, "source").select("module", "core", "low", "high"))
    reach = staged(reach.select("module", "core"))
    links = staged(reach.join(core, "module", "left_semi"))

    def step(fresh: DataFrame) -> DataFrame:
        by_name = single.join(fresh.select(F.col("module").alias("source"), F.col("name").alias("source_name"), "low", "high"), ["source", "source_name"]).where("module IS NOT NULL").select(*KEYS, "low", "high")
        by_glob = links.join(fresh.withColumnRenamed("module", "core"), "core").select(*KEYS, "low", "high").join(fixed, KEYS, "left_anti")
        return by_name.unionByName(by_glob)

    known = staged(fixpoint(declared.groupBy(*KEYS).agg(F.min("item").alias("low"), F.max("item").alias("high")), KEYS, step))
    rows = known.join(fixed.withColumn("explicit", F.lit(True)), KEYS, "full").withColumn("explicit", F.coalesce("explicit", F.lit(False)))
    # modules without names of their own, by the set of modules that they lead to; the least one stands for all of a set
    sets = staged(reach.join(core, "module", "left_anti").groupBy("module").agg(F.sha2(F.to_json(F.sort_array(F.collect_set("core"))), 256).alias("_set")))
    members = staged(sets.join(sets.groupBy("_set").agg(F.min("module").alias("_first"), F.count("*").alias("_times")), "_set").select("module", "_first", "_times"))
    firsts = members.where("module = _first").select("module", "_times")
    seen = reach.join(firsts, "module").join(known.withColumnRenamed("module", "core"), "core").groupBy("module", "name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("_times").alias("_times"))
    seen = staged(seen.withColumnRenamed("module", "_first"))
    made = seen.agg(F.sum("_times")).first()[0] or 0
    few = members.count() <= BROADCAST
    of = members.select("module", "_first")
    others = seen.drop("_times").repartition(1 + made // TASK_ROWS).join(F.broadcast(of) if few else of, "_first").select(*KEYS, "low", "high", F.lit(False).alias("explicit"))
    fault = F.when(F.col("low").isNull(), "unresolved").when(F.col("low") != F.col("high"), "conflict")
    return rows.select(*KEYS, "low", "high", "explicit").unionByName(others).select(*KEYS, F.when(F.col("low") == F.col("high"), F.col("low")).alias("item"), "explicit", fault.alias("fault"))
