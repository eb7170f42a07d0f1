"""Passages inside texts: whole passages found anywhere, by an equi join on a window of words and a check of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of an anchor; characters of the anchor of a passage without an inner word.
WINDOW, CHARACTERS = 3, 8


def windows(parts: Column, size: int) -> Column:
    """Hashes of all windows of so many parts. The shifted arrays are made once for each row, not for each window."""
    number = F.greatest(F.size(parts) - (size - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(parts, k + 1, number).alias(f"p{k}") for k in range(size)])
    return F.transform(zipped, lambda x: F.xxhash64(*[x[f"p{k}"] for k in range(size)]))


def anchor(parts: Column, first: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(parts, first + k) for k in range(size)])


def contained(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """item, path of each passage (item, passage) that a text (path, text) contains; null and empty passages are nowhere.

    Words lie between spaces. All of a passage's words but the first and last stand in a text that contains
    it as they are, so the two share each window of them: one from the passage's middle is its anchor. Passages
    with fewer inner words than a window have one of them as their anchor, and those without any their first
    characters. What meets by an anchor is checked by whole strings.
    """
    words = lambda c: F.split(c, " ", -1)
    inner = F.size(words("passage")) - 2
    some = passages.where("passage <> ''").select("item", "passage", words("passage").alias("_words"), F.split("passage", "").alias("_chars"), F.when(inner >= WINDOW, WINDOW).when(inner > 0, 1).otherwise(-F.least(F.length("passage"), F.lit(CHARACTERS))).alias("_width"))
    widths = sorted(r[0] for r in some.select("_width").distinct().collect())  # at most two and CHARACTERS
    if not widths:
        return texts.where("false").select(F.lit(None).cast(dict(passages.dtypes)["item"]).alias("item"), "path")
    middle = F.floor((F.size("_words") - F.col("_width")) / 2).cast("int")
    own, marks = F.lit(None).cast("bigint"), []
    for w in widths:
        own = F.when(F.col("_width") == w, anchor(F.col("_words"), middle, w) if w > 0 else anchor(F.col("_chars"), F.lit(0), -w)).otherwise(own)
        found = windows(words("text"), w) if w > 0 else windows(F.split("text", ""), -w)
        marks.append(F.transform(F.array_distinct(found), marked(w)))
    anchored = some.select("item", "passage", "_width", own.alias("_anchor"))
    spots = texts.where("text IS NOT NULL").select("path", F.explode(F.concat(*marks)).alias("_x")).select("path", "_x.*")
    met = spots.join(anchored.select("_width", "_anchor", "item"), ["_width", "_anchor"]).select("item", "path").distinct()
    return met.join(some.select("item", "passage"), "item").join(texts.select("path", "text"), "path").where(F.contains("text", F.col("passage"))).select("item", "path").distinct()


def marked(width: int):
    return lambda h: F.struct(F.lit(width).alias("_width"), h.alias("_anchor"))
