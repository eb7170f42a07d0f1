"""Periodic runs of words in linear time, from Lyndon arrays.

A run is a stretch of words with smallest period q that no neighbouring word extends. Each run has, under
an order of the words or under the reverse order, a root that is the longest Lyndon word where it begins;
so the next smaller suffix of each place, under both orders, gives all runs: the distance to it is the
period, and how far the two suffixes match tells where the run ends.

Next smaller suffixes are found from left to right: a stack holds the places that wait for one, and each new
place is compared with its top until a smaller suffix waits there. No suffix tree, suffix array or hash is
used: what two suffixes have in common follows from matches known before. Down the stack, a match shorter or
longer than the one known between the two upper entries settles the comparison without reading a word. Else
the match that reached furthest is used: its two sides read alike as far as it goes, so a pair behind its
right side takes over what its copy behind the left side, compared before, has in common. Only from there
are words read, and a word that agrees beyond that furthest place moves it on.

Words that a stretch holds fewer times than the least exponent lie in no run of it; stretches are cut
there first, which loses and changes no run.

Null text counts as empty: no runs, empty collapsed text. Texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_bytes, free, unclashing

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def lyndon(s: list[int]) -> tuple[list[int], list[int]]:
    """(where each place's next smaller suffix begins, len(s) if none; how many words the two suffixes share)."""
    n = len(s)
    after, ahead = [n] * n, [0] * n  # next smaller suffix, words shared with it
    before, behind = [-1] * n, [0] * n  # previous smaller suffix, words shared with it
    left = right = end = 0  # the match that reached furthest: s[right:end] reads as s[left:] does
    for r in range(1, n):
        k, same, known = r - 1, 0, 0  # k's and r's shared words, at least; k's and the place's above k on the stack
        while True:
            if same == known:
                if r < end:
                    copy = r - right + left
                    upper = k - right + left if k >= right else k
                    if upper == copy:
                        same = end - r
                    elif after[upper] == copy:
                        same = max(same, min(ahead[upper], end - r))
                    elif before[copy] == upper:
                        same = max(same, min(behind[copy], end - r))
                y = r + same
                x = k + same
                while y < n and s[x] == s[y]:
                    x += 1
                    y += 1
                same = y - r
                if y > end:
                    left, right, end = k, r, y
                smaller = y < n and s[x] < s[y]
            else:
                smaller = same > known  # k turned smaller than the place above it before r differed
                same = min(same, known)
            if smaller:
                before[r], behind[r] = k, same
                break
            after[k], ahead[k] = r, same
            known, k = behind[k], before[k]
            if k < 0:
                break
    return after, ahead


def of_order(s: list[int], times: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs whose words go on with a smaller one than the period asks for (or end)."""
    n = len(s)
    after, ahead = lyndon(s)
    for i in range(n):
        j = after[i]
        period = j - i
        if j >= n or ahead[i] + 2 * period <= times * period or (i >= period and after[i - period] == i and ahead[i - period] >= period):
            continue  # too few repeats, or not the run's first root
        left = 0
        while left < i and s[i - 1 - left] == s[j - 1 - left]:
            left += 1
        length = left + period + ahead[i]
        if length >= least and length >= times * period:
            yield i - left, length, period


def stretches(codes: np.ndarray, times: int, least: int) -> Iterator[tuple[int, int]]:
    """Ranges that hold all runs: cut at words that a range holds fewer than ``times`` times."""
    left = [(0, len(codes), 0)]
    while left:
        a, z, rounds = left.pop()
        part = codes[a:z]
        if len(part) < least or rounds == 4:  # a few rounds suffice; more only shorten ranges
            if len(part) >= least:
                yield a, z
            continue
        names, at, count = np.unique(part, return_inverse=True, return_counts=True)
        keep = count[at] >= times
        if keep.all():
            yield a, z
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, keep, False]))
        left += [(a + x, a + y, rounds + 1) for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True) if y - x >= least]


def runs_of(words: list, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``times`` periods (2 or more) and ``least`` words, by start and period.

    The alphabet is ordered by the words' first places.
    """
    names: dict = {}
    codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    found = set()
    for a, z in stretches(codes, times, least):
        s = codes[a:z].tolist()
        top = max(s)
        for order in (s, [top - c for c in s]):
            found.update((a + start, length, period) for start, length, period in of_order(order, times, least))
    return sorted(found, key=lambda r: (r[0], r[2]))


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:  # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Every row with all its columns and, after them, ``runs`` (array of start, length, period; by start, then period),
    ``best`` (the run of the greatest exponent, null without a run) and ``collapsed`` (names behind ``prefix``).

    Each partition is a stream; nothing is shuffled. An empty table gives no rows, repeated rows equal
    results; a column of docs with one of the result's names is an error.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods at least")
    kept = docs.columns
    names = [f"{prefix}{n}" for n in ("runs", "best", "collapsed")]
    unclashing(docs, *names)
    rows = docs.select("*", F.col(text_col).cast("string").cast("binary").alias(*free(docs, "_text")))
    at = len(kept)
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, best, texts = [], [], []
            for text in as_bytes(b.column(at)):
                words = WORDS(text)
                runs = runs_of(words, times, least)
                top = best_of(runs)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                best.append(None if top is None else dict(zip(("start", "length", "period"), top, strict=True)))
                texts.append(collapsed(words, runs).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), pa.array(found, pa.list_(run_type)), pa.array(best, run_type), pa.array(texts, pa.string())], [*kept, *names])

    shape = "struct<start: long, length: long, period: long>"
    types = [f"`{c}` {t}" for c, t in docs.dtypes]
    return rows.mapInArrow(run, ", ".join([*types, f"`{names[0]}` array<{shape}>", f"`{names[1]}` {shape}", f"`{names[2]}` string"]))
