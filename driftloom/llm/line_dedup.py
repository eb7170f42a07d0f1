"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line (text between line feeds) is the set of its words (between spaces, as they stand). Lines of all
texts are ordered by doc_id, then by place. A line goes when an earlier line, kept or not, has a Jaccard
similarity of at least 0.8 with it; lines without a word stay.

Equal lines are met by grouping. For the others, words are ordered by rarity, rarest first: by the
log2 class of a hashed counter over all words of all texts (a table of fixed size), then by hash, so that
every line uses one order. Lines that match have their first common word among the first
n - ceil(0.8 n) + 1 words of both (prefix filter); pairs that meet there must pass the length filter, the
positional filter and a parity sketch, whose Hamming distance never exceeds the symmetric difference.

* A semi join over narrow rows (word, line, sizes, sketch) keeps the lines that have any such partner. A
  line that occurs very often posts its words once: the most frequent lines, of bounded number, are found
  beforehand and broadcast.
* One more reading of the texts finds the first occurrences of these few lines, the copies of lines and the numbers of
  lines. The sets of the few are written once. Each line meets the ``EARLIEST`` earliest lines of each of its rarest words, so that many
  lines of one template make few pairs; the likeliest one is verified, sets being attached once.
* Lines that had an earlier partner but no verified one meet all of them, by a semi join that carries
  sets and leaves a line once for each word. Words of many such lines are split into blocks of lines.

Words are compared by 59-bit hashes and the class, lines by 128 bits. Null and empty texts
have no line that could go. Lines of rows with a null id stay and remove nothing. Repeated rows are the
same lines and don't remove each other. Empty tables give no rows. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import free, written

#: Hashed counters of words, 16 to a long; longs of a filter's bits (when it is full, more lines travel); most lines that are broadcast as frequent ones.
COUNTERS, FILTER, HOT = 1 << 18, 1 << 16, 100_000
#: Earliest lines of a word that others meet first; lines of a block of a word that many lines still share after that.
EARLIEST, BLOCK = 16, 500
#: Most words of a line whose sketch has 64 bits instead of 128.
SHORT = 48


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _no, _line and its name (_h1, _h2) for every line with a word."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("_no", "_line"))
    return named(rows.where(F.trim(F.col("_line")) != ""))


def named(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(7), "_line").alias("_h2"))


def place() -> Column:
    """The place of line _no of _id in the order of all lines, as one number, for aggregations."""
    at = F.col("_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("_no").cast("decimal(11,0)")
    return at.cast("decimal(32,0)")


def placed(of: str, id_: str, no: str) -> list[Column]:
    """The id and the line number of such a place."""
    return [F.floor(F.col(of) / F.lit(1 << 32)).cast("long").alias(id_), F.pmod(of, F.lit(1 << 32)).cast("int").alias(no)]


def earlier(id_: str, no: str, other_id: str, other_no: str) -> Column:
    return (F.col(id_) < F.col(other_id)) | ((F.col(id_) == F.col(other_id)) & (F.col(no) < F.col(other_no)))


def shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by.cast("int"))


def tabled(parts: DataFrame, size: int) -> DataFrame:
    """One row with _table, an array of the long _value of each _slot below ``size``, 0 where there is none. Its size is fixed."""
    every = parts.sparkSession.range(size).select(F.col("id").cast("int").alias("_slot"))
    filled = every.join(parts, "_slot", "left").select(F.struct("_slot", F.coalesce("_value", F.lit(0)).cast("long").alias("_value")).alias("_x"))
    return written(filled.agg(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["_value"]).alias("_table")))


def rarity(docs: DataFrame, text_col: str) -> DataFrame:
    """One row with _classes: the hashed counters' classes over all words, log2 of the count against the mean, at bits 59 to 62, where ``ordered`` needs them."""
    words = docs.select(F.explode(F.split(F.replace(F.col(text_col).cast("string"), F.lit("\n"), F.lit(" ")), " ")).alias("_w")).where("_w <> ''")
    counts = written(words.groupBy(F.xxhash64("_w").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("_at")).agg(F.count("*").alias("_n")))
    mean = (counts.agg(F.sum("_n")).first()[0] or 1) / COUNTERS
    level = F.greatest(F.lit(0), F.least(F.lit(15), F.floor(F.log2(F.col("_n") / F.lit(mean))) + 6)).cast("long")
    return tabled(counts.select(F.col("_at").alias("_slot"), F.shiftleft(level, 59).alias("_value")), COUNTERS).withColumnRenamed("_table", "_classes")


def ordered(line: Column, classes: Column) -> Column:
    """A line's distinct words as longs, rarest first."""

    def ranked(h: Column) -> Column:
        level = F.coalesce(F.get(classes, h.bitwiseAND(F.lit(COUNTERS - 1))), F.lit(0).cast("long"))  # never null, so the array is sorted as plain longs
        return level.bitwiseOR(F.shiftrightunsigned(h, 5))

    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    distinct = F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))  # before the ranks, so that the table of classes occurs once in a plan
    return F.sort_array(F.transform(distinct, ranked))


def need(a: Column, b: Column) -> Column:
    """Smallest overlap of sets of these sizes at Jaccard 0.8: ceil(8 (a + b) / 18)."""
    return F.floor((8 * (a + b) + 17) / 18).cast("int")


def sketched(sets: DataFrame) -> DataFrame:
    """With _s1 and _s2, a sketch of 128 bits: the parity of the words of _set that fall on each, for one half of the words and the other. Short lines have the sum of both in _s1 and 0 in _s2."""
    none = F.lit(0).cast("long")

    def parity(bits: list[int]) -> Column:
        table = F.array(*[F.lit(b).cast("long") for b in bits])  # looked up by a word's last bits, which takes fewer steps than to shift
        return F.coalesce(F.aggregate("_set", none, lambda a, h: a.bitwiseXOR(F.get(table, h.bitwiseAND(F.lit(len(bits) - 1))))), none)

    each = [1 << k if k < 63 else -1 << 63 for k in range(64)]
    parts = sets.select("*", parity(each).alias("_both"), F.when(F.col("_n") > SHORT, parity([0] * 64 + each)).otherwise(none).alias("_s2"))
    return parts.select(*sets.columns, F.col("_both").bitwiseXOR(F.col("_s2")).alias("_s1"), "_s2")


def with_sets(lines: DataFrame, classes: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, _set and _n."""
    # a subquery may not stand inside a function over words, but beside it; the optimiser puts it in, so no row holds the table.
    # As a literal the table would be in every text that Spark's driver makes of a plan, half a megabyte each time
    lines = lines.select(*carried, "_line", classes.scalar().alias("_classes"))
    # coalesce: columns that can't be null get no null checks, which the optimiser would push below and so compute the sets again
    sets = lines.select(*carried, F.coalesce(ordered(F.col("_line"), F.col("_classes")), F.array().cast("array<long>")).alias("_set"))
    return sets.select("*", F.coalesce(F.size("_set"), F.lit(0)).alias("_n"))


def posted(sets: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and _n, with _pos and _key: a row for each of a line's rarest words."""
    full = sets.select(*carried, "_n", F.expr("slice(_set, 1, _n - (8 * _n + 9) div 10 + 1)").alias("_rarest"))
    return full.select(*carried, "_n", F.posexplode_outer("_rarest").alias("_pos", "_key"))  # no line is without words; outer spares a check of the array below


def apart(n: Column | None = None, m: Column | None = None) -> Column:
    """The distance of the sketches of l and e, of these sizes (else their _n): at most the size of their symmetric difference."""
    n, m = F.col("l._n") if n is None else n, F.col("e._n") if m is None else m
    one, two = (F.col(f"l.{x}").bitwiseXOR(F.col(f"e.{x}")) for x in ("_s1", "_s2"))
    return F.when(F.least(n, m) > SHORT, F.bit_count(one) + F.bit_count(two)).otherwise(F.bit_count(one.bitwiseXOR(two)))


def near(l: list[Column], e: list[Column]) -> Column:
    """The filters of two lines l and e that share a word, cheapest first; of each, its size and the word's place in it."""
    (n, i), (m, j) = l, e
    least = need(n, m)
    possible = (F.least(n, m) * 10 >= F.greatest(n, m) * 8) & (apart(n, m) * 9 <= n + m)  # what follows implies the second
    return possible & (F.least(n - i, m - j) >= least) & (apart(n, m) <= n + m - 2 * least)


def packed(rows: DataFrame) -> DataFrame:
    """_n and _pos as one number, _at, which makes narrower rows."""
    return rows.withColumn("_at", F.shiftleft(F.col("_n").cast("long"), 32).bitwiseOR(F.col("_pos"))).drop("_n", "_pos")


def unpacked(at: str) -> list[Column]:
    return [F.shiftright(at, 32), F.col(at).bitwiseAND(F.lit((1 << 32) - 1))]


def matching() -> Column:
    """Whether the sets of l and e reach the threshold."""
    common = F.size(F.array_intersect("l._set", "e._set"))
    return common * 10 >= 8 * (F.col("l._n") + F.col("e._n") - common)


def filter_of(rows: DataFrame, *cols: str) -> Column:
    """A test of the columns that all of these rows pass, and few others until the table is full."""
    spots = [F.xxhash64(*cols, F.lit(seed)) for seed in (1, 2)]
    slot = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(FILTER - 1)).cast("int")
    bit = lambda h: shift_left(F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)))
    marks = rows.select(F.explode(F.array(*[F.struct(slot(h).alias("_slot"), bit(h).alias("_bit")) for h in spots])).alias("_x"))
    table = tabled(marks.groupBy("_x._slot").agg(F.bit_or("_x._bit").alias("_value")), FILTER).scalar()  # tasks get it from a subquery
    passes = [F.element_at(table, slot(h) + 1).bitwiseAND(bit(h)) != 0 for h in spots]
    return passes[0] & passes[1]


def later_matches(few: DataFrame) -> DataFrame:
    """_id and _no of the lines of few (_id, _no, _n, _set) that an earlier one of few matches."""
    few = written(sketched(few))
    line = ["_id", "_no"]
    words = posted(few, *line, "_s1", "_s2")
    earliest = words.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(*line))).where(F.col("_nth") <= EARLIEST).drop("_nth")
    pair = (F.col("l._key") == F.col("e._key")) & earlier("e._id", "e._no", "l._id", "l._no") & near(*([F.col(f"{x}._n"), F.col(f"{x}._pos")] for x in "le"))
    met = words.alias("l").join(earliest.alias("e"), pair).select("l._id", "l._no", F.struct(apart().alias("_apart"), F.col("e._id").alias("_other"), F.col("e._no").alias("_other_no")).alias("_e"))
    best = written(met.groupBy(*line).agg(F.min("_e").alias("_e")).select(*line, "_e._other", "_e._other_no"))
    sets = few.select(*line, "_n", "_set")
    mine = best.join(sets, line).alias("l")
    found = written(mine.join(sets.alias("e"), (F.col("l._other") == F.col("e._id")) & (F.col("l._other_no") == F.col("e._no"))).where(matching()).select("l._id", "l._no"))

    # who had none of the earliest lines of a word as a match, but may have another
    open_ = words.join(found, line, "left_anti")
    rest = written(open_.alias("l").join(words.alias("e"), pair, "left_semi"))
    if rest.isEmpty():
        return found
    blocks = rest.groupBy("_key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    mine = rest.join(blocks, "_key").withColumn("_block", F.pmod(F.xxhash64(*line), F.col("_blocks")).cast("int")).join(sets.drop("_n"), line)
    others = words.join(blocks, "_key").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).join(sets.drop("_n"), line)
    more = mine.alias("l").join(others.alias("e"), pair & (F.col("l._block") == F.col("e._block")) & matching(), "left_semi")
    return found.unionByName(more.select(*line).distinct())


def read_again(docs: DataFrame, wanted: DataFrame, twice: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What the rest of the work needs of the texts, read and written once, marked by _what; a row can be marked as more than one.

    1: a row of docs, with its _size in lines; 2: perhaps a line of wanted (_id, _no), with its _line; 4: perhaps one of the lines of twice (_h1).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.split(F.col(text_col).cast("string"), "\n").alias("_lines"))
    rows = named(rows.select("_id", F.coalesce(F.size("_lines"), F.lit(1)).alias("_size"), F.posexplode_outer("_lines").alias("_no", "_line")))
    full = F.col("_id").isNotNull() & F.coalesce(F.trim(F.col("_line")) != "", F.lit(False))
    marks = [F.coalesce(F.col("_no"), F.lit(0)) == 0, full & filter_of(wanted, "_id", "_no"), full & filter_of(twice, "_h1")]
    rows = rows.select("*", sum((F.when(m, 1 << k).otherwise(0) for k, m in enumerate(marks)), F.lit(0)).alias("_what")).where("_what > 0")
    return written(rows.select("_what", "_id", "_no", F.when(F.col("_what").bitwiseAND(F.lit(2)) > 0, F.col("_line")).alias("_line"), "_h1", "_h2", "_size"))


def line_work(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """_id and _gone, the sorted numbers (from 0) of the lines that go, of each id that loses lines; _id and _size, the number of lines, of every row."""
    lines = lines_of(docs, id_col, text_col)
    first = written(lines.groupBy("_h1", "_h2").agg(F.min(place()).alias("_first"), F.count("*").alias("_times")))
    total = first.agg(F.sum("_times")).first()[0] or 0
    hot = F.broadcast(first.where(F.col("_times") >= max(8, total // HOT + 1)).select("_h1", "_h2", *placed("_first", "_only", "_only_no")))

    classes = rarity(docs, text_col)
    once = lines.join(hot, ["_h1", "_h2"], "left").where("_only IS NULL OR (_id = _only AND _no = _only_no)")
    rows = packed(posted(sketched(with_sets(once, classes, "_h1")), "_h1", "_s1", "_s2"))
    some = rows.alias("l").join(rows.alias("e").hint("merge"), (F.col("l._key") == F.col("e._key")) & (F.col("l._h1") != F.col("e._h1")) & near(unpacked("l._at"), unpacked("e._at")), "left_semi").select("_h1").distinct()
    wanted = written(first.join(some, "_h1", "left_semi").select(*placed("_first", "_id", "_no")))
    twice = written(first.where("_times > 1").select("_h1", "_h2", *placed("_first", "_first", "_first_no")))

    again = read_again(docs, wanted, twice, id_col, text_col)
    marked = lambda k: again.where(F.col("_what").bitwiseAND(F.lit(k)) > 0)
    few = marked(2).select("_id", "_no", "_line").join(wanted, ["_id", "_no"], "left_semi").dropDuplicates(["_id", "_no"])
    near_lines = later_matches(with_sets(few, classes, "_id", "_no"))
    later = marked(4).select("_id", "_no", "_h1", "_h2").join(twice, ["_h1", "_h2"]).where(earlier("_first", "_first_no", "_id", "_no")).select("_id", "_no")
    gone = near_lines.unionByName(later).groupBy("_id").agg(F.sort_array(F.collect_set("_no")).alias("_gone"))
    return gone, marked(1).select("_id", "_size")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and _gone, the sorted numbers (from 0) of the lines that go, of each id that loses lines."""
    return line_work(docs, id_col, text_col)[0]


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the lines that go, from 0, joined by commas) for every row."""
    gone, sizes = line_work(docs, id_col, text_col)
    out = sizes.join(gone, "_id", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"), F.coalesce(F.array_join("_gone", ","), F.lit("")).alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with all its columns, its text without the lines that go."""
    own, numbers_ = free(docs, "_id", "_gone")
    gone = repeated_lines(docs, id_col, text_col).select(F.col("_id").alias(own), F.col("_gone").alias(numbers_))
    joined = docs.join(gone, F.col(id_col).cast("long") == F.col(own), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(numbers_, i)), "\n")
    return joined.select(*[F.when(F.col(numbers_).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])
