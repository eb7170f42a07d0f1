"""Three-way reconciliation of generated files: what a generation would write, remove, adopt or refuse.

before, disk and after are (path, digest), unique by path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actions(before: DataFrame, disk: DataFrame, after: DataFrame, adopt: bool = False) -> DataFrame:
    """path, action: write, remove, adopt, unchanged, nothing, or the refusals error_modified and error_unowned; files in no generation are left out."""
    side = lambda df, name: df.select("path", F.col("digest").alias(name))
    b, d, a = F.col("_before"), F.col("_disk"), F.col("_after")
    all_ = side(before, "_before").join(side(after, "_after"), "path", "full_outer").join(side(disk, "_disk"), "path", "left")
    action = (
        F.when(a.isNotNull() & d.isNull(), "write")
        .when(a.isNotNull() & b.isNotNull() & (d != b), "error_modified")
        .when(a.isNotNull() & b.isNotNull() & (d == a), "unchanged")
        .when(a.isNotNull() & b.isNotNull(), "write")
        .when(a.isNotNull(), F.when(F.lit(adopt) & (d == a), "adopt").otherwise("error_unowned"))
        .when(d.isNull(), "nothing")
        .when(d != b, "error_modified")
        .otherwise("remove")
    )
    return all_.select("path", action.alias("action"))


def recovery(before: DataFrame, disk: DataFrame, after: DataFrame) -> DataFrame:
    """path, state of an interrupted generation: done (as after), pending (as before, or absent, which the next generation's entry repairs), else conflict."""
    side = lambda df, name: df.select("path", F.col("digest").alias(name))
    all_ = side(before, "_before").join(side(after, "_after"), "path", "full_outer").join(side(disk, "_disk"), "path", "left")
    state = F.when(F.col("_disk").eqNullSafe(F.col("_after")), "done").when(F.col("_disk").isNull() | F.col("_disk").eqNullSafe(F.col("_before")), "pending").otherwise("conflict")
    return all_.select("path", state.alias("state"))
