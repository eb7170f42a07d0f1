"""Walks of module graphs: edges (parent, child), by rounds over the frontier or by doubled steps, cycles detected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.sources.stages import staged


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root, node, depth, path (names joined by slashes), seen (the same names as an array) of everything below the roots; a node that repeats on its own path ends there.

    Each round is one join of the last round's rows, staged, until none are left: a chain may be of any length.
    The visited nodes travel with each row.
    """
    step = staged(roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("depth"), F.array("node").alias("_seen")))
    out = [step]
    while True:
        below = step.join(edges.select(F.col("parent").alias("node"), "child"), "node").where(~F.array_contains("_seen", F.col("child")))
        step = staged(below.select("root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("_seen", F.col("child")).alias("_seen")))
        if step.isEmpty():
            break
        out.append(step)
    return reduce(DataFrame.unionByName, out).select("root", "node", "depth", F.array_join("_seen", "/").alias("path"), F.col("_seen").alias("seen"))


def cycles(edges: DataFrame, walk: DataFrame) -> DataFrame:
    """Edges that lead back to a node above their parent, or to it. Names may hold any characters."""
    on_path = walk.select(F.col("node").alias("parent"), F.col("seen").alias("_visited"))
    return edges.join(on_path, "parent").where(F.array_contains("_visited", F.col("child"))).select("parent", "child").distinct()


def jumps(steps: DataFrame) -> DataFrame:
    """at, end, hops, kind of the walk from each place of steps (at, to; at most one step leaves a place).

    kind: ended (end is the first place that no step leaves), on_cycle or to_cycle (end and hops are null).
    Each round joins the open walks with all walks and doubles their length, so a walk of n steps takes
    about log2(n) staged joins; walks that have ended aren't joined again. Places are of any type that can be joined;
    a step from or to a null place is none.
    """
    walks = staged(steps.where("at IS NOT NULL AND to IS NOT NULL").select("at", "to", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("ended")))
    places, length = walks.count(), 1
    while length <= places:
        known = walks.select(F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"))
        on = walks.where("NOT ended").join(known.hint("merge"), F.col("to") == F.col("_at"), "left")  # small files hold many steps: nothing is broadcast through the driver
        on = on.select("at", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.coalesce("_ended", F.lit(True)).alias("ended"))
        walks = staged(walks.where("ended").unionByName(on))
        length *= 2
        if walks.where("NOT ended").isEmpty():
            break
    lost = walks.where("NOT ended")  # longer than there are places: each is on a cycle by now, and each place of a cycle is some walk's
    on_cycle = lost.select(F.col("to").alias("at")).distinct().withColumn("_on", F.lit(True))
    turning = lost.join(on_cycle.hint("merge"), "at", "left").select("at", F.lit(None).cast(dict(steps.dtypes)["to"]).alias("end"), F.lit(None).cast("long").alias("hops"), F.when(F.col("_on"), "on_cycle").otherwise("to_cycle").alias("kind"))
    return walks.where("ended").select("at", F.col("to").alias("end"), "hops", F.lit("ended").alias("kind")).unionByName(turning)


def ancestry(edges: DataFrame) -> DataFrame:
    """node, top, depth, fault of each child: its topmost node and how far below it is, or why it has none.

    fault: several_parents, below_several_parents (above a node on its way up), on_cycle, below_cycle, or null.
    """
    ways = edges.groupBy("child").agg(F.min("parent").alias("parent"), (F.min("parent") != F.max("parent")).alias("_several"))
    ways = staged(ways)
    several = ways.where("_several").select(F.col("child").alias("node"))
    found = jumps(ways.where("NOT _several").select(F.col("child").alias("at"), F.col("parent").alias("to")))
    found = found.join(several.select(F.col("node").alias("end"), F.lit(True).alias("_split")).hint("merge"), "end", "left")
    fault = F.when(F.col("kind") == "on_cycle", "on_cycle").when(F.col("kind") == "to_cycle", "below_cycle").when(F.col("_split"), "below_several_parents")
    rows = found.withColumn("fault", fault).select(F.col("at").alias("node"), F.when(F.col("fault").isNull(), F.col("end")).alias("top"), F.when(F.col("fault").isNull(), F.col("hops")).alias("depth"), "fault")
    kind = dict(edges.dtypes)["parent"]
    return rows.unionByName(several.select("node", F.lit(None).cast(kind).alias("top"), F.lit(None).cast("long").alias("depth"), F.lit("several_parents").alias("fault")))


def wanted(nodes: DataFrame, required: DataFrame) -> DataFrame:
    """Nodes (path) that are a required path, above one, or below one. path: names joined by slashes, or an array of names that may hold slashes."""
    whole = dict(nodes.dtypes)["path"].startswith("array")
    tops = lambda c: F.transform(F.sequence(F.lit(1), F.size(c if whole else F.split(c, "/"))), lambda k: F.slice(c, F.lit(1), k) if whole else F.array_join(F.slice(F.split(c, "/"), F.lit(1), k), "/"))
    need = required.select(F.col("path").alias("_need")).distinct()
    above = need.select(F.explode(tops(F.col("_need"))).alias("path")).distinct()
    below = nodes.select("path", F.explode(tops(F.col("path"))).alias("_need")).join(need, "_need", "left_semi").select("path")
    return nodes.join(above.unionByName(below).distinct(), "path", "left_semi")


def disconnected(listed: DataFrame, reached: DataFrame) -> DataFrame:
    """Listed files that no walk reaches."""
    return listed.select("path").join(reached.select("path"), "path", "left_anti")
