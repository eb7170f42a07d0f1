"""Inventories of declared items: digests of groups, comparison, multiset diff, merging.

entries(entry_id, semantic_id, group_id, digest). groups are what a user labels: an entry belongs to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.digests import DOMAIN, digest, frame, framed, joined, optional, packed, unpacked
from driftloom.sources.stages import staged


def group_digests(entries: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """group_id, shape: digest of a group's (semantic_id, digest) pairs in order. Only a group's own rows meet in one place."""
    sent = entries.select("group_id", "semantic_id", packed(F.col("digest").cast("string")).alias("_d")).groupBy("group_id").agg(F.collect_list(F.struct("semantic_id", "_d")).alias("_x"))
    pairs = F.transform("_x", lambda x: F.struct(x["semantic_id"].alias("s"), unpacked(x["_d"]).alias("d")))
    frames = F.transform(F.sort_array(pairs), lambda x: F.concat(frame(x["s"]), frame(x["d"])))
    return sent.select("group_id", frames.alias("_frames")).select("group_id", digest(F.concat(framed(f"{domain}:group"), framed("source_shape"), joined(F.col("_frames")))).alias("shape"))


def contract_digest(shape: Column, extraction: Column, metadata: Column, domain: str = DOMAIN) -> Column:
    return digest(F.concat(framed(f"{domain}:group"), framed("contract"), frame(shape), optional(extraction), optional(metadata)))


def tree_digest(rows: DataFrame, key: Column, value: Column, head: Column, name: str, level: int = 4) -> DataFrame:
    """One row: _n and ``name``, the digest of all values in the order of (key, value), key being hexadecimal.

    Values whose keys begin with the same ``level`` characters make one digest each; the last one covers
    these, at most 16 ** level of them, in order. So no row grows with all the rows.
    """
    each = rows.select(F.left(key, F.lit(level)).alias("_at"), F.struct(key.alias("k"), value.alias("v")).alias("_x"))
    part = each.groupBy("_at").agg(F.count("*").alias("_n"), digest(joined(F.transform(F.sort_array(F.collect_list("_x")), lambda x: frame(x["v"])))).alias("_d"))
    all_ = part.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.sort_array(F.collect_list(F.struct("_at", "_d"))).alias("_all"))
    return all_.select("_n", digest(F.concat(head, joined(F.transform("_all", lambda x: frame(x["_d"]))))).alias(name))


def shape_digest(groups: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """One row: the number of groups and the tree digest of their shapes."""
    head = F.concat(framed(f"{domain}:inventory"), framed("source_shape"))
    return tree_digest(groups, F.col("shape"), F.col("shape"), head, "shape_digest").select(F.col("_n").alias("groups"), "shape_digest")


def inventory_contract_digest(groups: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """One row: the tree digest of (label, contract) of all groups (label, shape, extraction, metadata), in the order of the labels' digests."""
    head = F.concat(framed(f"{domain}:inventory"), framed("contract"))
    contract = contract_digest(F.col("shape"), F.col("extraction"), F.col("metadata"), domain)
    return tree_digest(groups, F.sha2(F.col("label"), 256), F.concat(frame(F.col("label")), frame(contract)), head, "contract_digest").select(F.col("_n").alias("groups"), "contract_digest")


def merged(entries: DataFrame) -> DataFrame:
    """Conflicts of a union of inventories: entry_id, fault; equal rows are one. duplicate_group before duplicate_digest."""
    seen = entries.groupBy("entry_id").agg(F.countDistinct("group_id").alias("_g"), F.countDistinct("digest").alias("_d"))
    return seen.where("_g > 1 OR _d > 1").select("entry_id", F.when(F.col("_g") > 1, "duplicate_group").otherwise("duplicate_digest").alias("fault"))


def differing(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """key, kind (missing, mismatched, extra), _theirs: the actual group that the key is compared with.

    A group's first failing entry, in entry order, decides its kind. An extra entry is keyed by the
    expected group of the entry that its own group names, else by its own group; keys that failed stay as they are.
    """
    sent = packed(F.col("digest").cast("string"))
    e = expected.select("entry_id", F.col("group_id").alias("e_group"), sent.alias("e_digest"))
    a = actual.select("entry_id", F.col("group_id").alias("a_group"), sent.alias("a_digest"))
    extra = F.col("e_digest").isNull()
    apart = e.join(a, "entry_id", "full_outer").where(extra | F.col("a_digest").isNull() | (F.col("e_digest") != F.col("a_digest")))
    # read three times below: staged, so that all entries meet once
    apart = staged(apart.select("entry_id", "e_group", "a_group", extra.alias("extra"), F.col("a_digest").isNotNull().alias("there")))
    first = apart.where("NOT extra").groupBy("e_group").agg(F.min(F.struct("entry_id", "there", "a_group")).alias("_f"))
    gone = ~F.col("_f.there")
    kinds = first.select(F.col("e_group").alias("key"), F.when(gone, "missing").otherwise("mismatched").alias("kind"), F.when(~gone, F.col("_f.a_group")).alias("_theirs"))
    extra = apart.where("extra").select("a_group").distinct()
    peer = expected.select(F.col("entry_id").alias("a_group"), F.col("group_id").alias("_label"))
    keyed = extra.join(peer, "a_group", "left").select(F.coalesce("_label", "a_group").alias("key"), F.col("a_group").alias("_theirs"))
    keyed = keyed.groupBy("key").agg(F.min("_theirs").alias("_theirs")).join(kinds, "key", "left_anti").select("key", F.lit("extra").alias("kind"), "_theirs")
    return kinds.unionByName(keyed)


def compared(expected: DataFrame, actual: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """key, kind (missing, mismatched, extra), expected_shape, actual_shape of the groups that differ."""
    shapes = lambda df, name: group_digests(df, domain).select(F.col("group_id").alias(f"_{name}"), F.col("shape").alias(f"{name}_shape"))
    out = differing(expected, actual).join(shapes(expected, "expected"), F.col("key") == F.col("_expected"), "left").join(shapes(actual, "actual"), F.col("_theirs") == F.col("_actual"), "left")
    return out.select("key", "kind", F.when(F.col("kind") != "extra", F.col("expected_shape")).alias("expected_shape"), "actual_shape")


FACETS = ("shape", "contract", "extraction", "metadata")


def changed_facets(a: str, b: str) -> Column:
    """Categories in their fixed order: source_semantics, extraction_context, document_metadata."""
    differ = lambda f: ~F.col(f"{a}{f}").eqNullSafe(F.col(f"{b}{f}"))
    return F.array_compact(F.array(F.when(differ("shape"), F.lit("source_semantics")), F.when(differ("extraction"), F.lit("extraction_context")), F.when(differ("metadata"), F.lit("document_metadata"))))


def residual(own: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``own`` left when equal rows of both sides cancel, numbered within their label."""
    place = Window.partitionBy("label").orderBy(*[F.col(f).asc_nulls_first() for f in FACETS])
    return surplus(own.select("label", *FACETS), other.select("label", *FACETS)).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n").withColumn("rn", F.row_number().over(place))


def surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows with _n, how many more of them the left side has (negative: the right side); equal numbers are left out. One grouping, summed before it is shuffled."""
    signed = left.withColumn("_n", F.lit(1).cast("long")).unionByName(right.withColumn("_n", F.lit(-1).cast("long")))
    return signed.groupBy(*left.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")


def diffed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """label, rn, change (changed, added, removed), categories and both sides' shape and contract.

    Rows (label, shape, contract, extraction, metadata). Within a label equal rows cancel and the rest pair
    by position. Unpaired rows are source_semantics if the number of their shape differs between the sides;
    else, where a group of the same shape has a label that this side doesn't have for it, labels and the
    facets that differ from that peer (one with the same contract, else the smallest contract).
    """
    prev, cur = residual(previous, current), residual(current, previous)
    p = prev.select("label", "rn", *[F.col(f).alias(f"p_{f}") for f in FACETS])
    c = cur.select("label", "rn", *[F.col(f).alias(f"c_{f}") for f in FACETS])
    both = p.join(c, ["label", "rn"], "full_outer")
    changed = both.where(F.col("p_shape").isNotNull() & F.col("c_shape").isNotNull()).select("label", "rn", F.lit("changed").alias("change"), changed_facets("p_", "c_").alias("categories"), "p_shape", "p_contract", "c_shape", "c_contract")

    def single(rows: DataFrame, own: DataFrame, other: DataFrame, change: str, x: str) -> DataFrame:
        count = lambda df, name: df.groupBy("shape").agg(F.count("*").alias(name))
        peers = other.join(own.select("label", "shape").distinct(), ["label", "shape"], "left_anti")
        mine = rows.select("label", "rn", *[F.col(f"{x}{f}").alias(f) for f in FACETS])
        order = Window.partitionBy("shape", "contract").orderBy("label", *[F.col(f).asc_nulls_first() for f in ("extraction", "metadata")])
        exact = peers.withColumn("_1", F.row_number().over(order)).where("_1 = 1").select("shape", "contract", F.struct(*FACETS).alias("_same"))
        least = peers.groupBy("shape").agg(F.min_by(F.struct(*FACETS), F.struct("contract", "label")).alias("_least"))
        full = mine.join(count(own, "_own"), "shape", "left").join(count(other, "_other"), "shape", "left").join(exact, ["shape", "contract"], "left").join(least, "shape", "left")
        full = full.withColumn("_peer", F.coalesce("_same", "_least")).select("*", *[F.col(f"_peer.{f}").alias(f"o_{f}") for f in FACETS], *[F.col(f).alias(f"m_{f}") for f in FACETS])
        facets = F.concat(F.filter(changed_facets("m_", "o_"), lambda k: k != "document_metadata"), F.array(F.lit("labels")), F.filter(changed_facets("m_", "o_"), lambda k: k == "document_metadata"))
        source = ~F.coalesce("_own", F.lit(0)).eqNullSafe(F.coalesce("_other", F.lit(0))) | F.col("_peer").isNull()
        side = {"p_": ("p_shape", "p_contract"), "c_": ("c_shape", "c_contract")}[x]
        empty = [F.lit(None).cast("string").alias(n) for n in ("p_shape", "p_contract", "c_shape", "c_contract") if n not in side]
        return full.select("label", "rn", F.lit(change).alias("change"), F.when(source, F.array(F.lit("source_semantics"))).otherwise(facets).alias("categories"), F.col("shape").alias(side[0]), F.col("contract").alias(side[1]), *empty)

    added = single(both.where(F.col("p_shape").isNull()), current, previous, "added", "c_")
    removed = single(both.where(F.col("c_shape").isNull()), previous, current, "removed", "p_")
    return changed.unionByName(added).unionByName(removed)


def shape_labels(groups: DataFrame) -> DataFrame:
    """shape, groups, labels: how many groups have a shape, and under which labels."""
    return groups.groupBy("shape").agg(F.count("*").alias("groups"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


def impl_groups(items: DataFrame) -> DataFrame:
    """Items of one owner and descriptor as one group: the earliest origin, and the distinct items in canonical order."""
    return items.groupBy("owner", "descriptor").agg(F.min("origin").alias("origin"), F.count("*").alias("items"), F.array_join(F.sort_array(F.collect_list("canonical")), "|").alias("canonical"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of each side that the other lacks, with multiplicity."""
    apart = surplus(left, right)
    each = F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int")))
    return apart.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("_n", each).drop("_n")
