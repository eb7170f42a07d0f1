"""Size-aware heavy-light Jaccard join of word-shingle sets.

Texts become sets of hashed word shingles. Equal sets form one class at once. Two classes link when
their Jaccard similarity reaches the threshold, and components of links are the result.

* Light sets (at most ``x`` shingles) enumerate, for every partner size that could reach the
  threshold, all their subsets of the overlap size that it takes; light sets that link share one.
* Heavy sets scan inverted lists. Under one global order, rarest first, a pair that links has its
  first common shingle among the first n - ceil(t*n) + 1 of both sets, so only the lists of these
  are kept. The order needs no exact counts to be correct: rarity comes from a fixed-size table of
  hashed counts over all shingles of all texts, ties are ordered by hash. Light sets also post these
  lists when they can reach a heavy set.
* ``x`` is chosen by cost: rows that enumeration would make against rows posted plus entries read in
  the lists, both summed over all sets of each size.

List entries are filtered by size, by position and by a 512-bit parity sketch (its Hamming distance
never exceeds the symmetric difference). Survivors are verified on whole sets. Long lists would hold
all pairs of a group of near copies; they are read in blocks of bounded size, and each block
first passes on only a spanning forest of its surviving pairs, likeliest first. When those are verified and
connected, a second reading of the long lists passes on every surviving pair whose ends are still in
different components; there, sets of more than 512 shingles carry parity sketches of about as many bits as
they have shingles, so that a group of texts just below the threshold makes few pairs. Candidate pairs of
both readings compare such sketches; only what these can't tell apart is sent whole sets. So no link that matters is lost and pairs inside a component are never expanded.

Shingles are compared by 64-bit hashes, sets by 128 bits. Null and empty texts, and texts without a
word, have an empty set and link with nothing. A text with fewer words than a shingle has its whole
sequence as the only one. doc_id names a text; repeated rows share one result. A null id is no
document of its own and gets a null component. Empty tables give no rows; only the id and the text
are read, so names of other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import CHUNK, Hasher, as_bytes, chunks, free, mix, numbers, written
from driftloom.llm.components import components

#: Hashed counters for rarity (bounded: one byte for each is broadcast), and slabs in which they are summed.
COUNTERS, SLABS = 1 << 20, 64
#: Largest set that may be light; rows of a block of a list; lists up to this length are read many at a time.
LIGHTEST, BLOCK, SHORT = 64, 1500, 12
#: Texts of a block of a large group whose whole sets meet in one task.
CELL = 200
#: Bits of a parity sketch; of the filter that spares texts without a candidate pair a shuffle (fixed: when it is full, more texts travel).
BITS, FILTER = 512, 1 << 24


class Join:
    """Words of a shingle; the threshold as a fraction num / den."""

    def __init__(self, words: int = 5, num: int = 8, den: int = 10) -> None:
        self.words, self.num, self.den = words, num, den

    def need(self, a, b):
        """Smallest overlap of sets of these sizes that reaches the threshold."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1 if n else 0

    def overlaps(self, n: int) -> list[int]:
        """Overlap sizes that a set of n shingles may need."""
        return sorted({int(self.need(n, m)) for m in range(-(-self.num * n // self.den), n * self.den // self.num + 1)})

    def enumerated(self, n: int) -> int:
        return sum(comb(n, c) for c in self.overlaps(n))


def shingles(hasher: Hasher, texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z are lower-cased."""
    w = hasher.words([t.lower() for t in texts])
    h = w.hashes()
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix(rolled + h[k : k + len(rolled)] + np.uint64(k + 1))
    out = []
    for first, last in zip(w.of[:-1], w.of[1:], strict=True):
        if last - first >= words:
            out.append(np.unique(rolled[first : last - words + 1]))
        elif last > first:
            short = np.zeros(1, np.uint64)
            for x in h[first:last]:
                short = mix(short + x + np.uint64(99))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(column: pa.Array, words: int, hasher: Hasher) -> Iterator[list[np.ndarray]]:
    texts = as_bytes(column)
    for first, last in chunks(texts, CHUNK):
        yield shingles(hasher, texts[first:last], words)


def rarity(rows: DataFrame, words: int) -> np.ndarray:
    """log2 class of each hashed counter, over the shingles of all texts."""
    each = COUNTERS // SLABS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(COUNTERS, np.int64)
        for b in batches:
            for sets in sets_of(b.column("_text"), words, hasher):
                total += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([zlib.compress(total[k * each : (k + 1) * each].tobytes(), 1) for k in range(SLABS)], pa.binary())], ["_slab", "_counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for slab, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.int64)
                totals[slab] = totals[slab] + part if slab in totals else part
        classes = {k: np.log2(np.maximum(v, 1)).astype(np.uint8).tobytes() for k, v in totals.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(classes), pa.int32()), pa.array(list(classes.values()), pa.binary())], ["_slab", "_classes"])

    out = np.zeros(COUNTERS, np.uint8)
    for r in rows.select("_text").mapInArrow(count, "_slab int, _counts binary").repartition("_slab").mapInArrow(add, "_slab int, _classes binary").collect():
        out[r._slab * each : (r._slab + 1) * each] = np.frombuffer(r._classes, np.uint8)
    return out


def parity(shingles_: np.ndarray) -> np.ndarray:
    """Parity sketch of a set with a power of two of bits, at least as many as shingles; halves of a longer one add up to a shorter one."""
    bits = max(BITS, 1 << max(0, len(shingles_) - 1).bit_length())
    return np.packbits(np.bincount((shingles_ % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def halved(sketch: np.ndarray, size: int) -> np.ndarray:
    """A parity sketch of so many bytes, made from a longer one."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def differences(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming distances of pairs of sketches, each pair at the size of its shorter one."""
    sizes = np.array([len(x) if x is not None else 0 for x in sketches])
    least, out = np.minimum(sizes[i], sizes[j]), np.zeros(len(i), np.int64)
    for size in np.unique(least):
        rows = np.flatnonzero(least == size)
        used, at = np.unique(np.r_[i[rows], j[rows]], return_inverse=True)
        words = np.array([halved(np.frombuffer(sketches[k], np.uint8), size) for k in used.tolist()]).view(np.uint64)
        for k in range(0, len(rows), 512):
            part = slice(k, k + 512)
            out[rows[part]] = np.bitwise_count(words[at[: len(rows)][part]] ^ words[at[len(rows) :][part]]).sum(axis=1)
    return out


SIGNED = "_id long, _n int, _high long, _low long, _bits binary, _sketch binary, _prefix array<long>, _all array<long>"


def signed(rows: DataFrame, join: Join, classes) -> DataFrame:
    """What the join needs of each set: size, 128-bit name, sketch, rarest shingles, and all of a small one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rank = Hasher(), classes.value.astype(np.uint64) << np.uint64(58)
        for b in batches:
            n, high, low, bits, wide, prefix, whole = [], [], [], [], [], [], []
            for sets in sets_of(b.column("_text"), join.words, hasher):
                for s in sets:
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        high.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                        low.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    own = parity(s)
                    bits.append(halved(own, BITS // 8).tobytes())
                    wide.append(own.tobytes() if 8 * len(own) > BITS else None)
                    order = np.argsort(rank[(s % np.uint64(COUNTERS)).astype(np.int64)] | (s >> np.uint64(6)), kind="stable")[: join.prefix(len(s))]
                    prefix.append(s[order].view(np.int64))
                    whole.append(s.view(np.int64) if len(s) <= LIGHTEST else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefix, longs), pa.array(whole, longs)], ["_id", "_n", "_high", "_low", "_bits", "_sketch", "_prefix", "_all"])

    return rows.mapInArrow(run, SIGNED)


def boundary(join: Join, sizes: dict[int, int], read: dict[int, int]) -> int:
    """The light-heavy boundary of least cost. sizes: sets of each size; read: list entries that the sets of each size post and read."""
    best, least, light = 0, 0, 0
    for n in range(1, LIGHTEST + 1):
        light += sizes.get(n, 0) * join.enumerated(n) - read.get(n, 0)
        if light <= least:
            best, least = n, light
    return best


def subsets(join: Join):
    """(_key, _rep, _n) of every subset that a light set enumerates. Rows in: _rep, _n, _all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, reps, sizes = [], [], []
            for rep, n, whole in zip(b.column("_rep").to_pylist(), b.column("_n").to_pylist(), b.column("_all").to_pylist(), strict=True):
                each = mix(np.array(whole, np.int64).view(np.uint64))
                total = each.sum(dtype=np.uint64)
                for c in join.overlaps(n):
                    if n - c == 0:
                        left = np.array([total])
                    else:
                        gone = np.array(list(combinations(range(n), n - c)))
                        left = total - each[gone].sum(axis=1, dtype=np.uint64)
                    keys.append(mix(left + np.uint64(c)).view(np.int64))
                    reps.append(np.full(len(left), rep))
                    sizes.append(np.full(len(left), n))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(reps), pa.int64()), pa.array(np.concatenate(sizes), pa.int32())], ["_key", "_rep", "_n"])

    return run


def forest_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges, taken in this order, join two trees."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes)).tolist()
    left, kept = len(nodes) - 1, []
    for e, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True)):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(e)
            left -= 1
            if not left:
                break
    return np.array(kept, int)


class Lists:
    """Reads sorted list entries as a stream and passes on pairs; forest: only a spanning forest of each long list's block."""

    def __init__(self, join: Join, light: int, forest: bool) -> None:
        self.join, self.light, self.forest = join, light, forest

    def survive(self, d: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that pass all filters, with their sketches' distance."""
        n, m = d["_n"][i], d["_n"][j]
        big, few = np.maximum(n, m), np.minimum(n, m)
        need = self.join.need(n, m)
        ok = (few * self.join.den >= big * self.join.num) & (np.minimum(n - d["_pos"][i], m - d["_pos"][j]) >= need) & (d["_rep"][i] != d["_rep"][j])
        ok &= (d["_light"][i]) | (big > self.light)  # two light sets meet in the lists of their subsets
        if "_root" in d:
            ok &= d["_root"][i] != d["_root"][j]
        i, j, most = i[ok], j[ok], (n + m - 2 * need)[ok]
        apart = np.zeros(len(i), np.int64)
        for k in range(d["_words"].shape[1]):
            apart += np.bitwise_count(d["_words"][i, k] ^ d["_words"][j, k])
        ok = apart <= most
        if "_sketch" in d:
            wide = np.flatnonzero(ok & d["_wide"][i] & d["_wide"][j])
            for k in range(0, len(wide), 4096):
                rows = wide[k : k + 4096]
                ok[rows] = differences(d["_sketch"], i[rows], j[rows]) <= most[rows]
        return i[ok], j[ok], apart[ok]

    def block(self, d: dict, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Survivors of one block of a long list; sides 0 and 1 are different blocks of it, else all pairs count."""
        side = d["_side"][first:last]
        left = np.flatnonzero(side == 0) + first
        right = np.flatnonzero(side == 1) + first
        found = []
        for k in range(0, len(left), 256):
            rows = left[k : k + 256]
            i, j = np.repeat(rows, len(right) or len(left)), np.tile(right if len(right) else left, len(rows))
            if not len(right):
                i, j = i[i < j], j[i < j]
            found.append(self.survive(d, i, j))
        i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        if self.forest and len(i):
            order = np.lexsort((d["_rep"][j], d["_rep"][i], apart))
            order = order[forest_of(i[order], j[order])]
            i, j, apart = i[order], j[order], apart[order]
        return i, j, apart

    def pairs(self, t: pa.Table) -> pa.RecordBatch:
        d = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("_bits", "_sketch")}
        if "_sketch" in t.column_names:
            d["_sketch"] = t.column("_sketch").to_pylist()
            d["_wide"] = np.array([x is not None for x in d["_sketch"]], bool)
        d["_n"], d["_pos"], d["_light"] = d["_n"].astype(np.int64), d["_pos"].astype(np.int64), d["_light"].astype(bool)
        d["_words"] = np.frombuffer(b"".join(t.column("_bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        ids = d["_list"]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        sizes = np.diff(np.r_[starts, len(ids)])
        out = []
        short = sizes <= SHORT
        nth = np.arange(len(ids)) - np.repeat(starts, sizes)
        nth = np.where(np.repeat(short, sizes), nth, 0)
        j = np.repeat(np.arange(len(ids)), nth)
        i = j - 1 - (np.arange(len(j)) - np.repeat(np.cumsum(nth) - nth, nth))
        out.append(self.survive(d, i, j))
        for k in np.flatnonzero(~short):
            out.append(self.block(d, starts[k], starts[k] + sizes[k]))
        i, j, _ = (np.concatenate(x) for x in zip(*out, strict=True))
        a, b = np.minimum(d["_rep"][i], d["_rep"][j]), np.maximum(d["_rep"][i], d["_rep"][j])
        both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["_a", "_b"])

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("_list").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last list may go on in the next batch
            if cut or (held and held[-1].column("_list")[-1].as_py() != ids[0]):
                yield self.pairs(pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held))
                held = []
            held.append(b.slice(cut))
        if held:
            yield self.pairs(pa.Table.from_batches(held))


def dealt(lists: DataFrame, partitions: int) -> DataFrame:
    """Entries (_key, _len, _rep, ...) dealt by list; a long list in pairs of blocks, so that no task holds a whole one."""
    blocks = F.ceil(F.col("_len") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("_rep"), blocks).cast("int")
    cut = lists.withColumn("_blocks", blocks).withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    named = cut.withColumn("_list", F.when(F.col("_blocks") == 1, F.xxhash64("_key", "_light")).otherwise(F.xxhash64("_key", "_light", low, high))).withColumn("_side", (F.col("_mine") > F.col("_other")).cast("int"))
    cols = [c for c in ("_list", "_side", "_rep", "_n", "_pos", "_light", "_bits", "_sketch", "_root") if c in named.columns]
    return named.select(cols).repartition(partitions, "_list").sortWithinPartitions("_list")


def places(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER)).astype(np.int64)


def likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose _id is among ids, and few more: ids are marked in a filter of fixed size, so that no text is shuffled."""

    each = FILTER // 8 // SLABS

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER // 8, np.uint8)
        for b in batches:
            at = places(b.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([zlib.compress(bits[k * each : (k + 1) * each].tobytes(), 1) for k in range(SLABS)], pa.binary())], ["_slab", "_bits"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slabs: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                slabs[k] = slabs.get(k, np.zeros(each, np.uint8)) | np.frombuffer(zlib.decompress(packed), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(slabs), pa.int32()), pa.array([x.tobytes() for x in slabs.values()], pa.binary())], ["_slab", "_bits"])

    some = np.zeros(FILTER // 8, np.uint8)
    for r in ids.mapInArrow(marked, "_slab int, _bits binary").repartition("_slab").mapInArrow(joined, "_slab int, _bits binary").collect():
        some[r._slab * each : (r._slab + 1) * each] = np.frombuffer(r._bits, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(some)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("_id").is_valid())
            at = places(b.column("_id").to_numpy())
            yield b.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1, pa.bool_()))

    return rows.mapInArrow(run, "_id long, _text string")


def near(pairs: DataFrame, reps: DataFrame, join: Join) -> DataFrame:
    """The pairs (_a, _b) that parity sketches of about as many bits as there are shingles can't tell apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("_xn", "_yn"))
            k = np.arange(b.num_rows)
            apart = differences(b.column("_x").to_pylist() + b.column("_y").to_pylist(), k, k + len(k))
            yield b.select(["_a", "_b"]).filter(pa.array(apart <= n + m - 2 * join.need(n, m), pa.bool_()))

    side = lambda a, x: reps.select(F.col("_rep").alias(a), F.coalesce("_sketch", "_bits").alias(x), F.col("_n").alias(f"{x}n"))
    return pairs.join(side("_a", "_x"), "_a").join(side("_b", "_y"), "_b").select("_a", "_b", "_x", "_y", "_xn", "_yn").mapInArrow(run, "_a long, _b long")


def verified(pairs: DataFrame, rows: DataFrame, join: Join) -> DataFrame:
    """The pairs (_a, _b) whose whole sets reach the threshold. rows: _id, _text.

    Pairs are dealt by connected group, large groups by pairs of blocks, so that a text travels once for
    each cell that it has pairs in: once, in a small group, however many pairs those are.
    """
    group = written(components(pairs))
    sizes = group.groupBy("_root").agg(F.ceil(F.count("*") / CELL).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int")
    of = written(group.join(sizes, "_root").select("_node", "_root", block.alias("_block")))
    both = pairs.join(of.select(F.col("_node").alias("_a"), "_root", F.col("_block").alias("_p")), "_a").join(of.select(F.col("_node").alias("_b"), F.col("_block").alias("_q")), "_b")
    cell = F.xxhash64("_root", F.least("_p", "_q"), F.greatest("_p", "_q"))
    placed = written(both.select(cell.alias("_cell"), "_a", "_b"))
    wanted = written(placed.select("_cell", F.explode(F.array("_a", "_b")).alias("_id")).distinct())
    texts = likely(rows, wanted.select("_id").distinct()).join(wanted, "_id").dropDuplicates(["_cell", "_id"]).select("_cell", "_id", "_text")

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            sets = [s.tobytes() for part in sets_of(b.column("_text"), join.words, hasher) for s in part]
            yield pa.RecordBatch.from_arrays([b.column("_cell"), b.column("_id"), pa.nulls(b.num_rows, pa.int64()), pa.array(sets, pa.binary())], ["_cell", "_a", "_b", "_set"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for batch in batches:
            out = []
            for c, a, b, s in zip(*(batch.column(k).to_pylist() for k in ("_cell", "_a", "_b", "_set")), strict=True):
                if c != cell:
                    cell, sets = c, {}
                if b is None:
                    sets[a] = np.frombuffer(s, np.uint64)
                    continue
                all_ = np.sort(np.concatenate([sets[a], sets[b]]), kind="stable")
                common = int((all_[1:] == all_[:-1]).sum())
                if common * join.den >= join.num * (len(all_) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["_a", "_b"])

    shape = "_cell long, _a long, _b long, _set binary"
    sets = texts.mapInArrow(whole, shape)
    cells = sets.unionByName(placed.withColumn("_set", F.lit(None).cast("binary")))
    return cells.repartition("_cell").sortWithinPartitions("_cell", F.col("_b").asc_nulls_first()).mapInArrow(check, "_a long, _b long")


def near_groups(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: components of links at Jaccard >= num / den."""
    spark, join = docs.sparkSession, Join(words, num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    classes = spark.sparkContext.broadcast(rarity(rows, words))
    table = written(signed(rows, join, classes))
    wide = numbers(spark, table.count(), 20_000)

    some = table.where("_n > 0 AND _id IS NOT NULL")
    classes_of = written(some.groupBy("_high", "_low").agg(F.min("_id").alias("_rep")))
    reps = written(some.select("_id", "_n", "_bits", "_sketch", "_prefix", "_all").join(classes_of.select(F.col("_rep").alias("_id")), "_id", "left_semi").dropDuplicates(["_id"]).withColumnRenamed("_id", "_rep"))

    entries = reps.select("_rep", "_n", F.posexplode("_prefix").alias("_pos", "_key"))
    n, m = F.col("l._n"), F.col("e._n")
    fits = (F.least(n, m) * den >= F.greatest(n, m) * num) & (F.least(n - F.col("l._pos"), m - F.col("e._pos")) >= F.ceil((num * (n + m)) / (num + den)))
    met = written(entries.alias("l").join(entries.alias("e"), (F.col("l._key") == F.col("e._key")) & (F.col("l._rep") != F.col("e._rep")) & fits, "left_semi"))
    heavy = written(met.join(met.groupBy("_key").agg(F.count("*").alias("_len")), "_key"))
    sizes = {r._n: (r.sets, r.posted) for r in reps.where(F.col("_n") <= LIGHTEST).groupBy("_n").agg(F.count("*").alias("sets"), F.sum(F.size("_prefix")).alias("posted")).collect()}
    read = {r._n: r.read for r in heavy.where(F.col("_n") <= LIGHTEST).groupBy("_n").agg(F.sum("_len").alias("read")).collect()}
    light = boundary(join, {n: s for n, (s, _) in sizes.items()}, {n: p + read.get(n, 0) for n, (_, p) in sizes.items()})

    small = reps.where(F.col("_n") <= light).select("_rep", "_n", "_all").mapInArrow(subsets(join), "_key long, _rep long, _n int")
    twice = small.groupBy("_key").agg(F.count("*").alias("_len")).where("_len > 1")
    lists = (
        heavy.where(F.col("_n") * den >= num * (light + 1)).select("_key", "_len", "_rep", "_n", "_pos", F.lit(False).alias("_light"))
        .unionByName(small.join(twice, "_key").select("_key", "_len", "_rep", "_n", F.lit(0).alias("_pos"), F.lit(True).alias("_light")))
    )
    lists = written(lists)
    sketched = lambda df, *more: df.join(reps.select("_rep", "_bits", *more), "_rep")

    first = written(dealt(sketched(lists), wide).mapInArrow(Lists(join, light, True), "_a long, _b long").distinct())
    links = written(verified(written(near(first, reps, join)), rows, join))
    roots = written(components(links))
    rest = lists.where(F.col("_len") > SHORT).join(roots.withColumnRenamed("_node", "_rep"), "_rep", "left").withColumn("_root", F.coalesce("_root", "_rep"))
    mixed = rest.groupBy("_key", "_light").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")).where("_low <> _high").select("_key", "_light")
    second = dealt(sketched(rest.join(mixed, ["_key", "_light"], "left_semi"), "_sketch"), wide).mapInArrow(Lists(join, light, False), "_a long, _b long").distinct()
    second = written(second.join(first, ["_a", "_b"], "left_anti"))
    if not second.isEmpty():
        links = links.unionByName(written(verified(written(near(second, reps, join)), rows, join)))
        roots = written(components(links))

    found = classes_of.join(roots.withColumnRenamed("_node", "_rep"), "_rep", "left").select("_high", "_low", F.coalesce("_root", "_rep").alias("_group"))
    out = table.join(found, ["_high", "_low"], "left")
    own = F.when(F.col("_n") > 0, F.col("_group")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_shingles"), F.when(F.col("_id").isNotNull(), own).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, with all their columns; repeated rows all stay or go."""
    (own,) = free(docs, "_id")
    groups = near_groups(docs, words, num, den, id_col, text_col)
    stay = groups.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left_semi")
