"""Language identification by the nearest of several centroids for each language.

A text becomes a vector of hashed character n-grams (one to three letters; letters are lower-cased,
everything else is a gap): (1 + ln tf) * idf, scaled to length 1. Document frequencies are counted
over all learnable rows. Each language's vectors are clustered by spherical k-means into up to
``CLUSTERS`` centroids; a text gets the language of the centroid with the largest cosine. It is
rejected when its distance to that centroid is beyond the centroid's radius, which depends on the
text's number of distinct n-grams, since poor texts, short or repetitive ones, lie farther out.

Clusters and radii are fitted on a bounded sample: about ``SAMPLE`` rows of each language, chosen by
a hash of the id, the same at every input size. Radii come from the sampled texts and from their first 1,
8, 16, ... letters, as far as they have so many: at each level of distinct n-grams, ``SPREAD`` times as far
from the median cosine as the 2nd percentile lies, and never below a share of that percentile. Languages are fitted one after another, so the driver
holds one language's sample. Everything else covers all rows.

A null text, or one without a letter, is ``und`` with score 0 and rejected. Rows without a language
or an id teach nothing. If no row teaches, all rows are ``und``. Ties go to the language that sorts
first. Repeated rows are scored alike; an empty table gives no rows; extra columns stay (predictions
go into names behind ``prefix``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_texts, carried, free, unclashing

#: Hashed n-grams; centroids of a language; rows of each language that k-means sees, about; its rounds.
DIMS, CLUSTERS, SAMPLE, ROUNDS = 8192, 3, 600, 8
#: Letters of the beginnings of sampled texts that teach radii; distinct n-grams at which these are measured (a text uses the largest that it reaches).
LENGTHS, LEVELS = (1, 8, 16, 32, 64, 128, 256, 1024), (1, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)
#: Radius beyond the median, in distances from it to the 2nd percentile, whose cosine divided by FLOOR is the least allowed; fewest points that make a level's radius.
SPREAD, FLOOR, POINTS = 5, 3, 20
#: Texts whose vectors are held at once.
TOGETHER = 48


class Grams:
    """Counts hashed n-grams of texts; keeps a table of which code points are letters."""

    def __init__(self) -> None:
        self.letter = np.full(0x110000, 2, np.uint8)  # 2: not looked up yet

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x DIMS counts, letters of each text)."""
        joined = "\n\n".join(["", *texts, ""]).lower()
        # lower() may change lengths, so boundaries are found from the texts' own lower forms
        sizes = np.array([len(t) if t.isascii() else len(t.lower()) for t in texts], np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.letter[codes]
        if (kind == 2).any():
            for c in np.unique(codes[kind == 2]):
                self.letter[c] = chr(c).isalpha()
            kind = self.letter[codes]
        codes = np.where(kind == 1, codes, 0).astype(np.uint32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 2)
        here = codes[2 : 2 + len(owner)]
        one, two = codes[1 : 1 + len(owner)], codes[: len(owner)]
        out = np.zeros(len(texts) * DIMS, np.float32)
        base = owner * np.int32(DIMS)
        shift = np.uint32(32 - 13)
        pair = here * np.uint32(0x9E3779B1) + one * np.uint32(0x85EBCA77)
        triple = pair + two * np.uint32(0xC2B2AE3D)
        for code, keep in ((here * np.uint32(0x9E3779B1), here > 0), (pair ^ np.uint32(0x27D4EB2F), (here | one) > 0), (triple ^ np.uint32(0x165667B1), one > 0)):
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            slot = base + (code >> shift).astype(np.int32)
            out += np.bincount(slot[keep], minlength=len(out)).astype(np.float32)
        letters = np.bincount(owner[here > 0], minlength=len(texts))
        return out.reshape(len(texts), DIMS), letters


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log(np.maximum(counts, 1), dtype=np.float32)
    x += counts > 0
    x *= idf
    return unit(x)


def grouped(column: pa.Array) -> Iterator[list[str]]:
    texts = as_texts(column)
    first, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= 1 << 18 or k + 1 - first >= TOGETHER:
            yield texts[first : k + 1]
            first, total = k + 1, 0
    if first < len(texts):
        yield texts[first:]


def clusters(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; the first seed is the mean, each next the row farthest from all so far."""
    seeds = [unit(x.mean(axis=0, keepdims=True))[0]]
    near = x @ seeds[0]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(x[int(near.argmin())])
        near = np.maximum(near, x @ seeds[-1])
    c = np.array(seeds)
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        c = np.array([unit(x[of == j].mean(axis=0, keepdims=True))[0] if (of == j).any() else c[j] for j in range(len(c))])
    return c


def levels(counts: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(LEVELS, (counts > 0).sum(axis=1), side="right") - 1, 0)


def heads_of(text: str) -> list[str]:
    """The beginnings with 1, 8, 16, ... letters."""
    out, letters = [], 0
    for i, c in enumerate(text):
        if c.isalpha():
            letters += 1
            if letters == LENGTHS[len(out)]:
                out.append(text[: i + 1])
                if len(out) == len(LENGTHS):
                    break
    return out


def radii(at: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The least cosine of each level; 0 where too few points teach it. It doesn't fall from a level to a richer one."""
    least = np.zeros(len(LEVELS))
    for k in range(len(LEVELS)):
        mine = cosine[at == k]
        if len(mine) >= POINTS:
            low, middle = np.percentile(mine, (2, 50))
            least[k] = max(middle - SPREAD * (middle - low), low / FLOOR)
    return np.maximum.accumulate(least)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, least: np.ndarray) -> None:
        self.langs, self.idf, self.centroids, self.of, self.least = langs, idf, centroids, of, least

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each row of counts."""
        if not len(self.centroids):
            return ["und"] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosine = vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(counts)), best].astype(float), 0, 1)
        level = levels(counts)
        rejected = (letters == 0) | (score < self.least[level, best])
        return [self.langs[self.of[b]] if n else "und" for b, n in zip(best, letters, strict=True)], np.where(letters > 0, score, 0.0), rejected


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """learn: which rows teach (rows with a null language never do)."""
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    of_lang = {r._lang: r.n for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), np.zeros(DIMS, np.int64)
        for b in batches:
            for texts in grouped(b.column(0)):
                total += (grams.counts(texts)[0] > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS), pa.int32()), pa.array(total, pa.int64())], ["_dim", "_df"])

    df = np.zeros(DIMS)
    for r in rows.select("_text").mapInArrow(frequencies, "_dim int, _df long").groupBy("_dim").agg(F.sum("_df").alias("n")).collect():
        df[r._dim] = r.n
    idf = np.log((1 + sum(of_lang.values())) / (1 + df)).astype(np.float32) + np.float32(0.1)

    share = F.create_map(*[F.lit(v) for lang, n in of_lang.items() for v in (lang, min(1.0, SAMPLE / n))])[F.col("_lang")] if of_lang else F.lit(1.0)
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000)

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            langs = iter(b.column(1).to_pylist())
            for texts in grouped(b.column(0)):
                full = [zlib.compress(c.astype(np.uint16).tobytes(), 1) for c in np.minimum(grams.counts(texts)[0], 65535)]
                heads = []
                for t in texts:  # what a short text of this language looks like, for the radii alone
                    some = heads_of(t)
                    heads.append(zlib.compress(grams.counts(some)[0].astype(np.uint16).tobytes(), 1) if some else None)
                sizes = [len(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([next(langs) for _ in texts], pa.string()), pa.array(full, pa.binary()), pa.array(heads, pa.binary()), pa.array(sizes, pa.int64())], ["_lang", "_full", "_heads", "_size"])

    seen = sample.select("_text", "_lang").mapInArrow(sampled, "_lang string, _full binary, _heads binary, _size long").orderBy("_lang", "_size", F.md5("_full")).toLocalIterator()
    unpacked = lambda b: np.frombuffer(zlib.decompress(b), np.uint16).reshape(-1, DIMS).astype(np.float32)
    langs, parts, least = [], [], []
    for lang, rows_ in groupby(seen, key=lambda r: r._lang):
        own = list(rows_)  # about SAMPLE of them, packed
        full = np.concatenate([unpacked(r._full) for r in own])
        x = vectors(full, idf)
        c = clusters(x, CLUSTERS)
        points = [(levels(full), (x @ c.T).max(axis=1))]
        for r in own:
            if r._heads is not None:
                head = unpacked(r._heads)
                points.append((levels(head), (vectors(head, idf) @ c.T).max(axis=1)))
        radius = radii(np.concatenate([p for p, _ in points]), np.concatenate([p for _, p in points]))
        langs.append(lang)
        parts.append(c)
        least += [radius] * len(c)
    centroids = np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32)
    of = np.array([k for k, p in enumerate(parts) for _ in p], int)
    least = np.array(least).reshape(-1, len(LEVELS)).T
    return Model(langs, idf, centroids.astype(np.float32), of, least)


def identified(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Every row with all its columns, lang_pred, score and rejected (names behind ``prefix``). Nothing is shuffled."""
    kept = docs.columns
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "rejected")]
    unclashing(docs, *names)
    shared = carried(docs.sparkSession, model)
    rows, at = docs.select("*", F.col(text_col).cast("string").alias(*free(docs, "_text"))), len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), shared.value
        for b in batches:
            langs, scores, out = [], [], []
            for texts in grouped(b.column(at)):
                lang, score, rejected = m.predict(*grams.counts(texts))
                langs += lang
                scores += score.tolist()
                out += rejected.tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], [*kept, *names])

    types = [f"`{c}` {t}" for c, t in docs.dtypes]
    return rows.mapInArrow(run, ", ".join([*types, f"`{names[0]}` string", f"`{names[1]}` double", f"`{names[2]}` boolean"]))
