"""Mixing sources to target weights by Poisson replication.

Every document repeats k times, where k comes from a Poisson distribution whose mean is its source's
target repetition rate, (target share of the source) * (target rows) / (rows of the source), by
inverting the distribution at a uniform number made from a hash of the seed and the id. Copies then go
through a global shuffle: dealt to partitions by a hash of the copy, and ordered by that hash inside.
The same seed always gives the same mixture, whatever the partitions.

A null source is a source of its own; a null id hashes as the text "null". Repeated rows repeat alike.
Sources without a weight, or of weight 0, disappear. Empty texts and nulls elsewhere are carried as
they are. Sums of rates above ``MOST`` start from the distribution's mode instead of at 0, where doubles
would underflow, and leave out counts more than 10 standard deviations and 30 below the mean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import free, numbers, unclashing, written

#: Largest rate whose sums start at 0; most sources whose rates are broadcast (more are joined by shuffling ids); rows of an output partition.
MOST, BROADCAST, EACH = 500, 5_000, 20_000


def hashed(seed: int, id_col: str, *more: Column) -> Column:
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), name, *[m.cast("string") for m in more]))


def number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of distributions with large means: terms relative to the mode's, divided by their total."""
    for b in batches:
        sums = []
        for rate in b.column("_rate").to_pylist():
            wide, mode = 10 * rate**0.5 + 30, int(rate)
            first = max(0, int(rate - wide))
            up = np.cumsum(np.log(rate / np.arange(mode + 1, int(rate + wide) + 2)))
            down = np.cumsum(np.log(np.arange(mode, first, -1) / rate))[::-1]
            all_ = np.cumsum(np.exp(np.r_[down, 0.0, up]))
            sums.append(np.r_[np.full(first, 1e-300), all_ / all_[-1]])  # below: passed by every hash but 0
        yield pa.RecordBatch.from_arrays([b.column("_source"), b.column("_rate"), pa.array(sums, pa.list_(pa.float64()))], ["_source", "_rate", "_cdf"])


def rates(docs: DataFrame, source_col: str = "source", temperature: float = 0.5, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """_source, _rate, _cdf: the repetition rate of each source and the distribution's sums as far as doubles reach.

    Target shares are proportional to ``weights``, or without them to rows ** temperature. ``size`` is
    the number of target rows as a multiple of the rows there are.
    """
    counts = written(docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_rows")))
    if weights is None:
        weight = F.pow(F.col("_rows").cast("double"), F.lit(float(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map()
        weight = F.coalesce(given[F.col("_source").cast("string")].cast("double"), F.lit(0.0))
    total = counts.agg(F.sum(weight).alias("weight"), F.sum("_rows").alias("rows")).first()
    share = weight / F.lit(total.weight) if total.weight else F.lit(0.0)
    rate = share * F.lit(total.rows) * F.lit(float(size)) / F.col("_rows")
    rated = counts.withColumn("_rate", rate)
    ends = F.sequence(F.lit(1), F.ceil(F.col("_rate") + 10 * F.sqrt("_rate") + 30).cast("int"))
    start = F.struct(F.exp(-F.col("_rate")).alias("term"), F.exp(-F.col("_rate")).alias("sum"), F.array(F.exp(-F.col("_rate"))).alias("all"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * F.col("_rate") / k
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"), F.concat(a["all"], F.array(a["sum"] + term)).alias("all"))

    low = rated.where(F.col("_rate") <= MOST).select("_source", "_rate", F.aggregate(ends, start, add, lambda a: a["all"]).alias("_cdf"))
    return low.unionByName(rated.where(F.col("_rate") > MOST).select("_source", "_rate").mapInArrow(around, f"_source {dict(low.dtypes)['_source']}, _rate double, _cdf array<double>"))


def mixed(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy", order_col: str = "order_key", **target) -> DataFrame:
    """Copies with all columns of docs, the copy's number from 0 and its place in the global order."""
    unclashing(docs, copy_col, order_col)
    source, rate, cdf, u, n = free(docs.select("*", F.lit(0).alias(copy_col), F.lit(0).alias(order_col)), "_source", "_rate", "_cdf", "_u", "_n")
    of_source = written(rates(docs, source_col, **target)).select(F.col("_source").alias(source), F.col("_rate").alias(rate), F.col("_cdf").alias(cdf))
    few = of_source.count() <= BROADCAST
    same = F.col(source_col).eqNullSafe(F.col(source))
    uniform = number(hashed(seed, id_col), 13) / F.lit(float(1 << 52))
    count = F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    joined = docs.join(F.broadcast(of_source) if few else of_source, same)  # beyond that size skewed sources are split by adaptive execution
    copies = joined.withColumn(u, uniform).withColumn(n, count).where(F.col(n) > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    placed = copies.withColumn(order_col, number(hashed(seed + 1, id_col, F.col(copy_col)), 15))
    rows = docs.count()
    return placed.select(*docs.columns, copy_col, order_col).repartition(numbers(docs.sparkSession, rows, EACH), order_col).sortWithinPartitions(order_col)
