"""A gated recurrent language model with class-factored output, scoring whole documents.

Tokens are words (A-Z lower-cased) and one end of each text. Word counts cover all texts that may teach.
The most frequent words, ``listed`` of them (their number grows with the counted vocabulary), are predicted one by one: P(word) = P(class) * P(word | class),
both softmaxes of the state of a gated recurrent unit. Every other word belongs to one of ``KINDS`` tail
classes by its form (its end, length and beginning); inside a tail class a word has probability
(c + 1) / (N + V + 1), where N and V are the class's tokens and distinct words among the counts and one
share is left for all unseen words together. So probabilities add up to 1 at every position.

The unit is trained on all texts that may teach, on Spark. Texts are dealt by a hash of the id to groups of
a bounded number of tokens. In each round every group of a slice starts from the broadcast unit and runs
backpropagation truncated to windows of ``WINDOW`` tokens, the state being carried from window to window
within a text; the next unit is the mean of the groups' parameters by tokens, summed block by block. All
slices together are one pass; a corpus of one group is read ``EPOCHS`` times. Scoring runs over all texts where they lie: texts of a batch advance together, and each
text's state is carried through all of its windows. Counts of the most frequent ``KNOWN`` words, a
table of bounded size, are broadcast; what a text has of rarer words goes through a join with the counts.

Words are compared by 64-bit hashes. Null counts as empty: the end is its only token. Texts with null
ids teach nothing. If nothing teaches, N and V are 0 and the model's tail share is 1 for every word.
Repeated rows are scored alike; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import CHUNK, Hasher, Words, as_bytes, carried, chunks, written

#: Words predicted one by one and classes of these, at least (both grow with the vocabulary); forms of the others.
SHORT, CLASSES, KINDS = 1000, 32, 36
#: Units of the state; tokens of a window; passes over a corpus of one group; texts read side by side, at least.
UNITS, WINDOW, EPOCHS, LANES = 16, 32, 3, 256
#: Windows of a group, about; slices of a pass over several groups; parameters of a block; tasks of a round, at least where there are as many groups.
STEPS, SLICES, BLOCK, TASKS = 128, 4, 1 << 16, 64
#: Largest factor by which a step may stretch a difference of states, for each gate: rounding can't grow along a text.
STRETCH = 1.0
#: Step of the training at its beginning.
RATE = 0.012
#: Words whose counts are broadcast, at most; distinct words that a task counts before it passes them on.
KNOWN, HELD = 1 << 19, 1_000_000
#: Tokens that a task gathers for one scoring, about (so that long texts find others of their length); texts that advance together; rows of one output step.
GATHERED, TOGETHER, ROWS = 4_000_000, 2048, 1024


def listed(words: int) -> int:
    """Words predicted one by one, of so many counted ones."""
    return max(SHORT, math.isqrt(words))


def lanes_of(words: int) -> int:
    """Texts read side by side: more for a longer list, so that a step's fixed cost stays in proportion to its tokens."""
    return max(LANES, words // 16)


def kinds(w: Words) -> np.ndarray:
    """The tail class of each word: how it ends (full stop, comma, else), its length, its first byte mod 4."""
    last, first, length = w.data[w.last - 1], w.data[w.first], w.last - w.first
    end = np.where(last == 46, 0, np.where(last == 44, 1, 2))
    size = (length > 5).astype(int) + (length > 9)
    return ((end * 3 + size) * 4 + first % 4).astype(np.int16)


class Vocabulary:
    """short: sorted hashes of the words predicted one by one, with their ids (0 is the end, tail classes follow the words)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, tail_tokens: np.ndarray, tail_words: np.ndarray) -> None:
        order = np.lexsort((hashes, -counts))
        self.words = len(hashes) + 1
        ids = np.empty(len(hashes), np.int32)
        ids[order] = np.arange(1, self.words)
        by_hash = np.argsort(hashes)
        self.hashes, self.ids = hashes[by_hash], ids[by_hash]
        share = np.sqrt(np.r_[ends, counts[order]] + 1.0)
        self.classes = max(CLASSES, math.isqrt(self.words))
        self.class_of = np.minimum((np.cumsum(share) - share) / share.sum() * self.classes, self.classes - 1).astype(int)
        self.tail_total = np.log10(tail_tokens + tail_words + 1.0)

    def encode(self, w: Words, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Ids of words: of the word, or self.words + its tail class."""
        ids = (self.words + kind).astype(np.int32)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            ids[hit] = self.ids[at[hit]]
        return ids


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def exponentials(logits: np.ndarray, small: bool) -> np.ndarray:
    """The log of the sum of each row's exponentials. The logits are overwritten. small: none is out of range."""
    if small:
        return np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))
    most = logits.max(axis=1, keepdims=True)
    logits -= most
    return most[:, 0] + np.log(np.exp(logits, out=logits).sum(axis=1))


def shares(e: np.ndarray, small: bool) -> None:
    """The softmax of each row, in place. small: no logit is out of range."""
    if not small:
        e -= e.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    e *= (1 / (e @ np.ones(e.shape[1], e.dtype)))[:, None]


class Unit:
    """Parameters: g, each token's input to the gates; u, the state's; c, cb: classes; o, ob: words within their classes."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 3) -> None:
        r, f = np.random.default_rng(seed), np.float32
        self.v = vocabulary
        classes = vocabulary.classes + KINDS
        self.p = {
            "g": r.normal(0, 0.1, (vocabulary.words + KINDS, 3 * UNITS)).astype(f),
            "u": r.normal(0, UNITS**-0.5, (UNITS, 3 * UNITS)).astype(f),
            "c": np.zeros((UNITS, classes), f), "cb": np.zeros(classes, f),
            "o": np.zeros((vocabulary.words, UNITS), f), "ob": np.zeros(vocabulary.words, f),
        }
        ends = np.searchsorted(vocabulary.class_of, np.arange(vocabulary.classes + 1))  # words of a class have neighbouring ids
        self.rooms: dict[str, np.ndarray] = {}
        self.members = [slice(a, z) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that is used again in the next window (fresh memory costs more than what is done with it)."""
        size, kind = math.prod(shape), self.p["u"].dtype
        if name not in self.rooms or len(self.rooms[name]) < size or self.rooms[name].dtype != kind:
            self.rooms[name] = np.empty(size, kind)
        return self.rooms[name][:size].reshape(shape)

    def move(self, x: np.ndarray, a: np.ndarray, h: np.ndarray, gates: np.ndarray, new: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The next states into out, from the tokens' inputs x, the states h and their products a; the gates and new values too."""
        n = UNITS
        np.add(x[:, : 2 * n], a[:, : 2 * n], out=gates)
        np.negative(gates, out=gates)
        np.exp(np.minimum(gates, 30, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[:, :n], a[:, 2 * n :], out=new)
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= gates[:, n:]
        out += new
        return out

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states after these tokens, the gates and the new values."""
        x, a = self.p["g"][ids], h @ self.p["u"]
        gates, new = np.empty((len(h), 2 * UNITS), a.dtype), np.empty_like(a[:, :UNITS])
        return self.move(x, a, h, gates, new, np.empty_like(new)), gates, new

    def small(self, h: np.ndarray) -> bool:
        """Whether no logit of these states can be so large or low that its exponential leaves the range of floats."""
        p, most = self.p, max(1.0, float(np.abs(h).max(initial=0)))
        return all(float((np.abs(w).sum(axis=k) * most + np.abs(b)).max(initial=0)) < 80 for w, k, b in ((p["c"], 0, p["cb"]), (p["o"], 1, p["ob"])))

    def classes_of(self, targets: np.ndarray) -> np.ndarray:
        words = self.v.words
        return np.where(targets < words, self.v.class_of[np.minimum(targets, words - 1)], self.v.classes + targets - words)

    def log_probability(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for words of the short list, P(word | class)."""
        out = np.empty(len(targets))
        cls, small = self.classes_of(targets), self.small(h)
        for s in range(0, len(targets), ROWS):
            rows = slice(s, s + ROWS)
            logits = h[rows] @ self.p["c"]
            logits += self.p["cb"]
            own, total = logits[np.arange(len(logits)), cls[rows]], exponentials(logits, small)
            out[rows] = own - total
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.v.classes + 1))
        inside = order[: ends[-1]]
        h, own_place, more = h[inside], targets[inside], np.zeros(len(inside))
        for k, m in enumerate(self.members):
            rows = slice(ends[k], ends[k + 1])
            if ends[k] < ends[k + 1] and m.stop - m.start > 1:
                logits = h[rows] @ self.p["o"][m].T
                logits += self.p["ob"][m]
                own, total = logits[np.arange(len(logits)), own_place[rows] - m.start], exponentials(logits, small)
                more[rows] = own - total
        out[inside] += more
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, counts: np.ndarray, h: np.ndarray):
        """One window of lanes (time x lanes): loss, gradients, and the state to carry. fresh: a text begins; counts: a token is there."""
        p, n, lanes, long = self.p, UNITS, inputs.shape[1], len(inputs)
        grads = {k: np.zeros_like(x) for k, x in p.items() if k != "u"}
        kind = p["u"].dtype
        before, new, hs, dn = (self.room(x, long, lanes, n) for x in ("before", "new", "hs", "dn"))
        x, a, gates = self.room("x", long, lanes, 3 * n), self.room("a", long, lanes, 3 * n), self.room("gates", long, lanes, 2 * n)
        np.take(p["g"], inputs, axis=0, out=x, mode="clip")
        r, z, an, begins = gates[:, :, :n], gates[:, :, n:], a[:, :, 2 * n :], fresh.any(axis=1)
        for t in range(long):
            before[t] = h
            if begins[t]:
                before[t][fresh[t]] = 0
            np.matmul(before[t], p["u"], out=a[t])
            h = self.move(x[t], a[t], before[t], gates[t], new[t], hs[t])
        flat, live, hs = targets.ravel(), counts.ravel(), hs.reshape(-1, n)
        total, small, whole = self.v.classes + KINDS, self.small(hs), bool(live.all())
        cls, dh, ones = np.where(live, self.classes_of(flat), total), self.room("dh", *hs.shape), np.ones(max(ROWS, len(flat)), kind)
        place, chances = np.arange(len(flat)), np.ones(len(flat), kind)
        for s in range(0, len(flat), ROWS):
            rows = slice(s, s + ROWS)
            e = self.room("e", len(flat[rows]), total)
            np.matmul(hs[rows], p["c"], out=e)
            e += p["cb"]
            shares(e, small)
            there = place[: len(e)] if whole else np.flatnonzero(live[rows])
            own = cls[rows][there]
            chances[rows][there] = e[there, own]
            e[there, own] -= 1
            if not whole:
                e[~live[rows]] = 0
            grads["c"] += hs[rows].T @ e
            grads["cb"] += ones[: len(e)] @ e
            np.matmul(e, p["c"].T, out=dh[rows])
        loss = -float(np.log(chances + 1e-12).sum())
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.v.classes + 1)).tolist()
        inside = order[: ends[-1]]
        mine, own_place, dmine, chances = hs[inside], flat[inside], np.zeros((len(inside), n), kind), np.ones(len(inside), kind)
        for k, m in enumerate(self.members):
            if ends[k] < ends[k + 1] and m.stop - m.start > 1:
                rows, o = slice(ends[k], ends[k + 1]), p["o"][m]
                states = mine[rows]
                e = states @ o.T
                e += p["ob"][m]
                shares(e, small)
                own = (place[: len(e)], own_place[rows] - m.start)
                chances[rows] = e[own]
                e[own] -= 1
                np.matmul(e.T, states, out=grads["o"][m])
                np.matmul(ones[: len(e)], e, out=grads["ob"][m])
                np.matmul(e, o, out=dmine[rows])
        loss -= float(np.log(chances + 1e-12).sum())
        dh[inside] += dmine
        dh = dh.reshape(long, lanes, n)
        # what doesn't depend on later tokens, for all of the window at once
        by_new, by_z, by_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), an * r * (1 - r)
        gx, da = x, self.room("da", long, lanes, 3 * n)  # x isn't needed any more
        carried, back = np.zeros_like(hs[:lanes]), np.ascontiguousarray(p["u"].T)
        for t in range(long - 1, -1, -1):
            d = dh[t] + carried
            np.multiply(d, by_new[t], out=dn[t])
            np.multiply(dn[t], by_r[t], out=da[t, :, :n])
            np.multiply(d, by_z[t], out=da[t, :, n : 2 * n])
            np.multiply(dn[t], r[t], out=da[t, :, 2 * n :])
            np.matmul(da[t], back, out=carried)
            d *= z[t]
            carried += d
            if begins[t]:
                carried[fresh[t]] = 0
        gx[:, :, : 2 * n], gx[:, :, 2 * n :] = da[:, :, : 2 * n], dn
        grads["u"] = before.reshape(-1, n).T @ da.reshape(-1, 3 * n)
        order = np.argsort(inputs.ravel(), kind="stable")
        tokens = inputs.ravel()[order]
        gx = gx.reshape(-1, 3 * n)
        for s in range(0, len(tokens), ROWS):
            some = tokens[s : s + ROWS]
            starts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            grads["g"][some[starts]] += np.add.reduceat(gx[order[s : s + ROWS]], starts, axis=0)
        return loss, int(live.sum()), grads, h.copy()

    def train(self, texts: list[np.ndarray], seed: int = 3, done: float = 0.0, share: float = 1.0) -> int:
        """Truncated backpropagation with Adam over texts (ids that end with the end), each read once. Returns the tokens.

        done: share of the whole training before; share: of these texts' round. The rate falls over the whole.
        """
        r, moments, count, tokens = np.random.default_rng(seed), {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in self.p.items()}, 0, 0
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(texts):
            return 0
        few = max(16, int(sizes.sum()) // (100 * WINDOW))  # of few tokens, narrow windows make about 100 steps
        lanes = max(1, min(lanes_of(self.v.words), len(texts), 4 * int(sizes.sum()) // int(sizes.max()), few))
        rows: list[list[int]] = [[] for _ in range(lanes)]
        filled = np.zeros(lanes, int)
        for k in sorted(r.permutation(len(texts)).tolist(), key=lambda k: -int(sizes[k]) // 500):
            rows[at := int(filled.argmin())].append(k)
            filled[at] += sizes[k]
        rows = [[rows[k][x] for x in r.permutation(len(rows[k]))] for k in np.argsort(-filled, kind="stable")]  # longest lanes first
        filled = -np.sort(-filled)
        ids, fresh = np.zeros((int(filled[0]), lanes), np.int32), np.zeros((int(filled[0]), lanes), bool)
        for lane, mine in enumerate(rows):
            ids[: filled[lane], lane] = np.concatenate([texts[k] for k in mine])
            fresh[np.cumsum([0, *sizes[mine[:-1]]]), lane] = True
        inputs = np.zeros_like(ids)
        inputs[1:] = ids[:-1]
        inputs[fresh] = 0
        there = np.arange(len(ids))[:, None] < filled
        h = np.zeros((lanes, UNITS), np.float32)
        for s in range(0, len(ids), WINDOW):
            n = int(np.searchsorted(-filled, -s))  # lanes longer than s
            long, window = min(WINDOW, len(ids) - s), (slice(s, s + WINDOW), slice(0, n))
            _, live, grads, h = self.gradients(inputs[window], ids[window], fresh[window], there[window], h[:n])
            tokens, count = tokens + live, count + 1
            rate = RATE * max(0.05, 1 - done - share * (s + long) / filled[0])
            size = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / max(1, live)
            for k, g in grads.items():
                g *= np.float32(min(1.0, 1.0 / max(size, 1e-9)) / max(1, live))
                m = moments[k]
                move = self.room("move", *g.shape)
                m[0] += np.multiply(np.subtract(g, m[0], out=move), np.float32(0.1), out=move)
                g *= g
                g -= m[1]
                g *= np.float32(0.01)
                m[1] += g
                np.sqrt(np.multiply(m[1], np.float32(1 / (1 - 0.99**count)), out=g), out=g)
                g += np.float32(1e-8)
                self.p[k] -= np.multiply(np.divide(m[0], g, out=move), np.float32(rate / (1 - 0.9**count)), out=move)
            for k in range(0, 3 * UNITS, UNITS):
                gate = self.p["u"][:, k : k + UNITS]
                gate *= np.float32(min(1.0, STRETCH / max(1e-9, np.linalg.norm(gate, 2))))
        return tokens

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size

    def begin(self, counts: np.ndarray) -> None:
        """Biases of the outputs before training: the logs of what was counted. counts: of words, then of tail classes."""
        n = counts + 1.0
        words, tails = n[: self.v.words], n[self.v.words :]
        self.p["ob"][:] = np.log(words)
        by_class = np.bincount(self.v.class_of, weights=words, minlength=self.v.classes)
        self.p["cb"][:] = np.log(np.r_[np.maximum(by_class, 1e-3), tails] / n.sum())
        for m in self.members:
            if m.stop > m.start:
                self.p["ob"][m] -= self.p["ob"][m].max()

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each text's classes and short-list words."""
        out = np.zeros(len(texts))
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for s in range(0, len(order), TOGETHER):
            mine = order[s : s + TOGETHER]
            size = np.array([len(texts[k]) for k in mine])
            flat = np.concatenate([texts[k] for k in mine]).astype(np.int64)
            at = np.cumsum(size) - size
            h, total = np.zeros((len(mine), UNITS), np.float32), np.zeros(len(mine))
            for first in range(0, size[0], WINDOW):
                states, targets, lanes = [], [], []
                for t in range(first, min(first + WINDOW, size[0])):
                    n = int(np.searchsorted(-size, -t))  # texts longer than t
                    inputs = flat[at[:n] + t - 1] if t else np.zeros(n, np.int64)
                    h = self.step(inputs, h[:n])[0]
                    states.append(h)
                    targets.append(flat[at[:n] + t])
                    lanes.append(np.arange(n))
                total += np.bincount(np.concatenate(lanes), weights=self.log_probability(np.concatenate(states), np.concatenate(targets)), minlength=len(mine))
            out[mine] = total
        return out


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums counts of equal hashes."""
    h, k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, k, n = h[order], k[order], n[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    return h[starts], k[starts], np.add.reduceat(n, starts) if len(h) else n


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, by hash; a task holds a bounded number of them."""

    def out(held) -> pa.RecordBatch:
        h, k, n = merge(held)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64()), pa.array(k, pa.int16()), pa.array(n, pa.int64())], ["_word", "_kind", "_c"])

    hasher = Hasher()
    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.int64))]
    new = 0
    for b in batches:
        texts = as_bytes(b.column(0))
        for first, last in chunks(texts, 4 * CHUNK):
            w = hasher.words([t.lower() for t in texts[first:last]])
            h = w.hashes()
            held.append(merge([(h, kinds(w), np.ones(len(h), np.int64))]))
            new += len(held[-1][0])
            if new > HELD // 2:
                held, new = [merge(held)], 0
                if len(held[0][0]) > HELD:
                    yield out(held)
                    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.int64))]
    yield out(held)


def taught(lessons: DataFrame, unit: Unit, tokens: int) -> int:
    """Trains the unit on all rows of lessons (_slot: a hash of the id; _ids: int32 tokens of a text). Returns the tokens that taught, over all passes."""
    spark = lessons.sparkSession
    slots = -(-tokens // (STEPS * WINDOW * lanes_of(unit.v.words)))  # groups of a pass
    slices = SLICES if slots > 1 else 1
    rounds = slices if slots > 1 else EPOCHS * (tokens > 0)
    groups = max(1, -(-slots // slices))
    tasks = min(groups, max(TASKS, spark.sparkContext.defaultParallelism))
    total = 0
    for turn in range(rounds):
        shared = carried(spark, unit)

        def learn(batches: Iterable[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            start = shared.value.flat()
            sums, weight, group, texts = np.zeros(len(start)), 0, None, []

            def close() -> int:
                unit = Unit(shared.value.v)
                unit.take(start)
                if n := unit.train(texts, turn * 1_000_003 + group, turn / rounds, 1 / rounds):
                    np.add(sums, n * unit.flat().astype(float), out=sums)
                texts.clear()
                return n

            for b in batches:
                for g, ids in zip(b.column("_group").to_pylist(), b.column("_ids").to_pylist(), strict=True):
                    if g != group:
                        weight += close() if texts else 0
                        group = g
                    texts.append(np.frombuffer(ids, np.int32))
            weight += close() if texts else 0
            for k in range(0, len(sums) if weight else 0, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([group], pa.int64()), pa.array([weight], pa.int64()), pa.array([sums[k : k + BLOCK].tobytes()], pa.binary())], ["_block", "_group", "_tokens", "_sums"])

        def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                for k, n, x in zip(*(b.column(c).to_pylist() for c in ("_block", "_tokens", "_sums")), strict=True):
                    mine = held.setdefault(k, [0, 0.0])
                    mine[0], mine[1] = mine[0] + n, mine[1] + np.frombuffer(x)
            for k, (n, x) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())], ["_block", "_tokens", "_mean"])

        mine = lessons.where(F.pmod(F.col("_slot"), F.lit(slices)) == turn % slices)
        dealt = mine.withColumn("_group", F.pmod(F.xxhash64("_slot", F.lit(turn)), F.lit(groups))).withColumn("_task", F.pmod("_group", F.lit(tasks)).cast("int"))
        ordered = dealt.repartitionById(tasks, "_task").sortWithinPartitions("_group", "_slot", F.xxhash64("_ids"), "_ids").select("_group", "_ids")
        parts = ordered.mapInArrow(learn, "_block int, _group long, _tokens long, _sums binary")
        means = parts.repartition(min(tasks, 8), "_block").sortWithinPartitions("_block", "_group").mapInArrow(added, "_block int, _tokens long, _mean binary").collect()  # one unit's parameters
        shared.unpersist()
        if means:
            unit.take(np.concatenate([np.frombuffer(r._mean, np.float32) for r in sorted(means)]))
            total += means[0]._tokens
    return total


def likelihoods(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    teach = rows.where(learn)
    counts = written(teach.select("_text").mapInArrow(count_words, "_word long, _kind short, _c long").groupBy("_word").agg(F.min("_kind").alias("_kind"), F.sum("_c").alias("_c")))
    ends = teach.count()
    level = F.floor(F.log2("_c") * 16).cast("int")
    levels = sorted(((r.l, r.n, r.c) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.sum("_c").alias("c")).collect()), reverse=True)
    n, v = ends + sum(x[2] for x in levels), (ends > 0) + sum(x[1] for x in levels)

    def top(most: int) -> int:
        """The lowest level above which there are at most so many words."""
        total, least = 0, 1 << 30
        for at, words, _ in levels:
            if (total := total + words) > most:
                break
            least = at
        return least

    cut = top(KNOWN)
    known = counts.where(level >= cut).select("_word", "_kind", "_c").toArrow()  # at most KNOWN rows
    h, c, k = known["_word"].to_numpy().view(np.uint64), known["_c"].to_numpy(), known["_kind"].to_numpy()
    order = np.lexsort((h, -c))[: listed(v)]
    tails = {r._kind: (r.c, r.n) for r in counts.groupBy("_kind").agg(F.sum("_c").alias("c"), F.count("*").alias("n")).collect()}
    tokens, words = (np.array([tails.get(x, (0, 0))[y] for x in range(KINDS)], np.int64) for y in (0, 1))
    tokens -= np.bincount(k[order], weights=c[order], minlength=KINDS).astype(np.int64)
    words -= np.bincount(k[order], minlength=KINDS)
    vocabulary = Vocabulary(h[order], c[order], ends, tokens, words)

    by_hash = np.argsort(h)
    table = spark.sparkContext.broadcast((h[by_hash], c[by_hash]))
    shared = carried(spark, vocabulary)

    def encoded(hasher: Hasher, texts: list[bytes], voc: Vocabulary):
        w = hasher.words([t.lower() for t in texts])
        hashes, kind = w.hashes(), kinds(w)
        ids = voc.encode(w, hashes, kind)
        return w, hashes, kind, ids, [np.r_[ids[a:z], np.int32(0)] for a, z in zip(w.of[:-1], w.of[1:], strict=True)]

    def lessons(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            texts = as_bytes(b.column(1))
            for first, last in chunks(texts, CHUNK):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array([x.tobytes() for x in encoded(hasher, texts[first:last], shared.value)[4]], pa.binary())], ["_slot", "_ids"])

    unit = Unit(vocabulary)
    unit.begin(np.r_[ends, -np.sort(-c[order]), tokens].astype(float))
    if n:
        slot = F.xxhash64(F.col("_id").cast("string"), F.lit(5)).alias("_slot")
        taught(written(teach.select(slot, "_text").mapInArrow(lessons, "_slot long, _ids binary")), unit, n)
    ready = carried(spark, unit)
    whole = np.log10(n + v + 1.0)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, unit = Hasher(), ready.value
        voc, (top_words, top_counts) = unit.v, table.value
        logs = np.log10(top_counts + 1.0)
        end = np.log10(ends + 1.0) - whole
        names, found, parts, gathered = [], [], [], 0

        def out() -> pa.RecordBatch:
            model = unit.score(found) / np.log(10) if found else np.zeros(0)
            cat = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)
            bounds = np.cumsum(np.r_[0, cat(6)]).astype(np.int32)
            lists = lambda k: pa.ListArray.from_arrays(pa.array(bounds), pa.array(cat(k).astype(np.int64)))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(names), pa.array(cat(0).astype(np.int64)), pa.array(cat(1).astype(np.int64)), pa.array(cat(2), pa.float64()), pa.array(model + cat(3), pa.float64()), lists(4), lists(5)],
                ["_id", "_tokens", "_known", "_base", "_model", "_words", "_times"],
            )

        for b in batches:
            texts = as_bytes(b.column(1))
            names.append(b.column(0))
            for first, last in chunks(texts, CHUNK):
                w, hashes, kind, ids, each = encoded(hasher, texts[first:last], voc)
                found += each
                of = np.repeat(np.arange(last - first), np.diff(w.of))
                at = np.minimum(np.searchsorted(top_words, hashes), max(0, len(top_words) - 1))
                hit = top_words[at] == hashes if len(top_words) else np.zeros(len(hashes), bool)
                sums = lambda x, which: np.bincount(of[which], weights=x, minlength=last - first)  # noqa: B023, E731
                tail = hit & (ids >= voc.words)
                base, known_ = sums(logs[at[hit]] - whole, hit) + end, np.bincount(of[hit], minlength=last - first) + (ends > 0)
                inside = sums(logs[at[tail]] - voc.tail_total[kind[tail]], tail)
                rare = np.flatnonzero(~hit)
                rare = rare[np.lexsort((hashes[rare], of[rare]))]
                word, text = hashes[rare], of[rare]
                starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])]) if len(rare) else rare
                times = np.diff(np.r_[starts, len(rare)])
                parts.append((np.diff(w.of) + 1, known_, base, inside, word[starts].view(np.int64), kind[rare[starts]].astype(np.int64) << 40 | times, np.bincount(text[starts], minlength=last - first)))
            gathered += sum(len(x) for x in found[-len(texts) :]) if texts else 0
            if gathered >= GATHERED:
                yield out()
                names, found, parts, gathered = [], [], [], 0
        if names:
            yield out()

    shape = f"_id {dict(rows.dtypes)['_id']}, _tokens long, _known long, _base double, _model double, _words array<long>, _times array<long>"
    first = written(rows.mapInArrow(score, shape).withColumn("_row", F.monotonically_increasing_id()))
    totals = F.element_at(F.array(*[F.lit(float(x)) for x in vocabulary.tail_total]), F.shiftright("_time", 40).cast("int") + 1)
    times = F.col("_time").bitwiseAND(F.lit((1 << 40) - 1))
    rare = first.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("_x")).select("_row", F.col("_x._words").alias("_word"), F.col("_x._times").alias("_time"))
    joined = rare.join(counts.where(level < cut).select("_word", "_c"), "_word", "left")
    log = F.log10(F.coalesce(F.col("_c"), F.lit(0)) + F.lit(1.0))
    more = joined.groupBy("_row").agg(F.sum(F.when(F.col("_c").isNotNull(), times).otherwise(0)).alias("_k"), F.sum(times * (log - F.lit(float(whole)))).alias("_b"), F.sum(times * (log - totals)).alias("_m"))
    out = first.select("_row", "_id", "_tokens", "_known", "_base", "_model").join(more, "_row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(F.col("_id"), F.col("_tokens").alias("n_tokens"), plus("_known", "_k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("_base", "_b").alias("base_score"), plus("_model", "_m").alias("score"))
