"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise term is computed in time
linear in the features, as half of the sum over factors of (sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2.

Features of a text: its distinct words, hashed to ``WORDS`` slots, each 1 / sqrt(distinct words); counts
and shares of bytes, words and lines (see ``STATS``); and one piece of metadata, the stated number of
characters. Statistics are scaled by the training sample's mean and deviation. The machine is fitted
on the driver, in numpy, to at most about ``SAMPLE`` labelled rows, whose features take at most about
``BYTES`` bytes: of longer texts, fewer rows teach, chosen by the same hash.

Null and empty texts get the score of a text without words; a null stated length is a feature of its
own. Rows without a label, or with one that isn't 0 or 1, teach nothing; if none teaches, or all have
one label, the score is that label's share (0.5 without any). Repeated rows score alike, an empty table
gives no rows, and extra columns stay (results go into names behind ``prefix``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import CHUNK, Hasher, as_bytes, carried, chunks, folded, free, labelled, unclashing, written

#: Slots for words; factors; labelled rows that teach, about; passes over them.
WORDS, FACTORS, SAMPLE, EPOCHS = 1 << 16, 8, 12_000, 12
BYTES = 64_000_000  # of the features of the rows that teach
STATS = (
    "log bytes", "log words", "log lines", "mean word bytes", "letters", "capitals", "digits", "symbols", "non-ASCII bytes", "line ends",
    "distinct words", "most frequent word", "words equal to the word before", "words that end in a tripled symbol", "one-byte words", "distinct lines", "sentence ends", "stated characters", "no stated characters", "stated less found bytes",
)


def kinds() -> np.ndarray:
    """Class of each byte: 0 space, 1 small letter, 2 capital, 3 digit, 4 symbol, 5 non-ASCII, 6 line end, 7 sentence end."""
    out = np.full(256, 4, np.uint8)
    out[128:] = 5
    out[[9, 11, 12, 13, 32]] = 0
    out[97:123], out[65:91], out[48:58], out[10] = 1, 2, 3, 6
    out[[33, 44, 46, 63]] = 7
    return out


class Features:
    def __init__(self) -> None:
        self.hasher, self.kinds = Hasher(), kinds()

    def of(self, texts: list[bytes], stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, slots, stats): slots[ends[k]:ends[k+1]] are the distinct words' slots of text k. Numbers are floats; stated may hold nan."""
        w = self.hasher.words(texts)
        n, size = len(texts), np.array([len(t) for t in texts], float)
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
        kind = self.kinds[w.data[1 : 1 + bounds[-1]]]  # each text and the line end after it
        owner = np.repeat(np.arange(n), np.diff(bounds))
        by_kind = np.bincount(owner * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
        by_kind[:, 6] -= 1
        words = np.diff(w.of).astype(float)
        h = w.hashes()
        doc = np.repeat(np.arange(n), np.diff(w.of))
        key = (doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
        unique, counts = np.unique(key, return_counts=True)
        of_unique = (unique >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(of_unique, minlength=n).astype(float)
        top = np.zeros(n)
        np.maximum.at(top, of_unique, counts)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        last = w.last - 1
        tripled = (w.last - w.first >= 3) & (w.data[last] == w.data[last - 1]) & (w.data[last] == w.data[last - 2]) & (self.kinds[w.data[last]] == 4)
        ends = np.flatnonzero(w.data == 10)
        lines = np.searchsorted(bounds + 1, ends[1:], side="right") - 1
        line = folded(h, np.diff(np.searchsorted(w.first, ends)))
        line_key = np.unique((lines.astype(np.uint64) << np.uint64(40)) | (line >> np.uint64(24)))
        distinct_lines = np.bincount((line_key >> np.uint64(40)).astype(np.int64), minlength=n)[:n].astype(float)
        some, more = np.maximum(size, 1), np.maximum(words, 1)
        per_doc = lambda flags: np.bincount(doc[flags], minlength=n) / more
        told = np.nan_to_num(stated)
        stats = np.stack(
            [
                np.log1p(size), np.log1p(words), np.log1p(by_kind[:, 6]), np.minimum((size - by_kind[:, 0]) / more, 100), (by_kind[:, 1] + by_kind[:, 2]) / some, by_kind[:, 2] / some, by_kind[:, 3] / some, by_kind[:, 4] / some, by_kind[:, 5] / some, by_kind[:, 6] / some,
                distinct / more, top / more, per_doc(again), per_doc(tripled), per_doc(w.last - w.first == 1), distinct_lines / (by_kind[:, 6] + 1), by_kind[:, 7] / more, np.log1p(np.maximum(told, 0)), np.isnan(stated) * 1.0, np.clip((size - told) / some, -2, 2),
            ],
            axis=1,
        )
        slot = ((unique >> np.uint64(8)) % np.uint64(WORDS)).astype(np.int32)
        return np.searchsorted(of_unique, np.arange(n + 1)), slot, stats.astype(np.float32)


class Machine:
    """w0; w and v of the words' slots, then of the statistics; mean and deviation of the statistics."""

    def __init__(self, w0, w, v, mean, deviation) -> None:
        self.w0, self.w, self.v, self.mean, self.deviation = w0, w, v, mean, deviation

    def sums(self, ends: np.ndarray, slots: np.ndarray, stats: np.ndarray):
        """(z, linear and factor sums): what scoring and training share."""
        x = np.clip((stats - self.mean) / self.deviation, -6, 6)
        count = np.diff(ends)
        value = (1 / np.sqrt(np.maximum(count, 1))).astype(np.float32)
        doc = np.repeat(np.arange(len(count)), count)
        words = np.bincount(doc, weights=self.w[slots], minlength=len(count)) * value
        full = ends[:-1][count > 0]
        first = np.zeros((len(count), FACTORS), np.float32)
        second = np.zeros_like(first)
        if len(slots):
            rows = self.v[slots]
            first[count > 0] = np.add.reduceat(rows, full, axis=0) * value[count > 0, None]
            second[count > 0] = np.add.reduceat(rows * rows, full, axis=0) * value[count > 0, None] ** 2
        vs = self.v[WORDS:]
        first += x @ vs
        second += (x * x) @ (vs * vs)
        z = self.w0 + words + x @ self.w[WORDS:] + 0.5 * (first * first - second).sum(axis=1)
        return z, x, first, value, doc

    def score(self, ends, slots, stats) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(ends, slots, stats)[0], -30, 30)))


def train(labels: np.ndarray, slots: list[np.ndarray], stats: np.ndarray, seed: int = 5) -> Machine:
    """Adagrad on log loss with L2 shrinkage, in a fixed order of the rows."""
    share = float(labels.mean()) if len(labels) else 0.5
    width = len(STATS)
    mean = stats.mean(axis=0) if len(labels) else np.zeros(width, np.float32)
    deviation = np.maximum(stats.std(axis=0), 1e-3) if len(labels) else np.ones(width, np.float32)
    random = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(WORDS + width, np.float32), np.zeros((WORDS + width, FACTORS), np.float32), mean.astype(np.float32), deviation.astype(np.float32))
    if len(labels) < 2 or share in (0.0, 1.0):
        share = min(max(share, 0.0), 1.0)
        m.w0 = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return m
    m.w0 = float(np.log(share / (1 - share)))
    m.v = random.normal(0, 0.02, m.v.shape).astype(np.float32)
    seen = [np.full(m.w.shape, 1.0, np.float32), np.full(m.v.shape, 1.0, np.float32)]
    rate, shrink = 0.15, 2e-4
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            ends = np.r_[0, np.cumsum([len(slots[r]) for r in rows])]
            flat = np.concatenate([slots[r] for r in rows]) if ends[-1] else np.zeros(0, np.int32)
            z, x, first, value, doc = m.sums(ends, flat, stats[rows])
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[rows]).astype(np.float32)
            m.w0 -= 0.02 * float(g.mean())
            each = (g * value)[doc]
            gw = np.zeros(len(m.w), np.float32)
            np.add.at(gw, flat, each)
            gw[WORDS:] = g @ x
            touched = np.unique(flat)
            touched = np.r_[touched, np.arange(WORDS, WORDS + width)]
            gv = np.zeros((len(touched), FACTORS), np.float32)
            at_v = np.searchsorted(touched, flat)
            np.add.at(gv, at_v, each[:, None] * (first[doc] - m.v[flat] * value[doc][:, None]))
            gv[-width:] = (g[:, None] * x).T @ first - ((x * x).T @ g)[:, None] * m.v[WORDS:]
            gw = gw[touched] / len(rows) + shrink * m.w[touched]
            gv = gv / len(rows) + shrink * m.v[touched]
            seen[0][touched] += gw * gw * 100
            seen[1][touched] += gv * gv * 100
            m.w[touched] -= rate * gw / np.sqrt(seen[0][touched]) * 5
            m.v[touched] -= rate * gv / np.sqrt(seen[1][touched])
    return m


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", bound: int = SAMPLE) -> Machine:
    sample = labelled(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), F.col(size_col).cast("double").alias("_size")), labels, label_col, learn, bound, id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            texts, stated, given = as_bytes(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2)
            for first, last in chunks(texts, CHUNK):
                ends, slots, stats = features.of(texts[first:last], stated[first:last])
                yield pa.RecordBatch.from_arrays([given.slice(first, last - first), pa.array([slots[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], ["_label", "_slots", "_stats"])

    found = written(sample.select("_text", "_size", "_label").mapInArrow(run, "_label int, _slots binary, _stats binary"))
    share = min(1.0, BYTES / max(1, found.agg(F.sum(F.length("_slots"))).first()[0] or 0))
    rows = found.where(F.pmod(F.xxhash64("_slots", "_stats"), F.lit(1_000_000)) < share * 1_000_000).collect() if share < 1 else found.collect()
    rows.sort(key=lambda r: (hashlib.md5(r._slots).digest(), hashlib.md5(r._stats).digest(), r._label))
    stats = np.array([np.frombuffer(r._stats, np.float32) for r in rows], np.float32).reshape(-1, len(STATS))
    return train(np.array([r._label for r in rows], np.float32), [np.frombuffer(r._slots, np.int32) for r in rows], stats)


def scored(docs: DataFrame, machine: Machine, text_col: str = "text", size_col: str = "n_chars", prefix: str = "") -> DataFrame:
    """Every row with all its columns and its score (behind ``prefix``). Nothing is shuffled; the machine's size is fixed."""
    name, kept = f"{prefix}score", docs.columns
    unclashing(docs, name)
    shared, at = carried(docs.sparkSession, machine), len(kept)
    text, size = free(docs, "_text", "_size")
    rows = docs.select("*", F.col(text_col).cast("string").alias(text), F.col(size_col).cast("double").alias(size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for b in batches:
            texts, stated = as_bytes(b.column(at)), b.column(at + 1).to_numpy(zero_copy_only=False).astype(float)
            scores = [m.score(*features.of(texts[first:last], stated[first:last])) for first, last in chunks(texts, CHUNK)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], [*kept, name])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{name}` double"]))
