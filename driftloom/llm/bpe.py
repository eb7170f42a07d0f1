"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text, the encoder stores one number: the last token of the encoding of
that prefix. It is unique, since BPE is deterministic, and it is found from the tokens that end
there: a token fits if its bytes end the prefix and if it can follow the last token of the prefix
before it, that is, if merging the bytes of the two together gives back just those two. Reading the
stored numbers backwards gives the whole encoding; appending bytes only adds entries, and an edit
keeps all entries before it.

Null text counts as empty: no tokens, and the digests of the empty string. Bytes that no token has
raise KeyError (the files used here have all 256). Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import Hasher, as_texts, chunks, free, unclashing

#: Ids of encoded pieces that a task remembers (a full memory is emptied); bytes of pieces that are encoded together.
MEMORY, LONGEST = 4_000_000, 64
#: Characters of texts that are encoded together.
GROUP = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """ranks: token bytes -> id, which is also the priority of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.length = {i: len(t) for t, i in ranks.items()}
        self.build()
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def build(self) -> None:
        """The tokens' automaton: what all prefixes of tokens lead to, byte by byte, and the tokens that end there."""
        step: dict[int, int] = {}  # node * 256 + byte -> node
        ends = [-1]
        for t, i in self.ranks.items():
            node = 0
            for byte in t:
                following = step.get(node << 8 | byte)
                if following is None:
                    following = step[node << 8 | byte] = len(ends)
                    ends.append(-1)
                node = following
            ends[node] = i
        fail, longest, shorter = [0] * len(ends), [-1] * len(ends), {}
        made = sorted((node, key) for key, node in step.items())
        level = {0: 0}
        for node, key in made:
            level[node] = level[key >> 8] + 1
        for node, key in sorted(made, key=lambda x: level[x[0]]):
            up, byte = fail[key >> 8], key & 255
            while up and (up << 8 | byte) not in step:
                up = fail[up]
            target = step.get(up << 8 | byte, 0)
            fail[node] = target if target != node else 0
            if ends[node] >= 0:
                shorter[ends[node]] = longest[fail[node]]
                longest[node] = ends[node]
            else:
                longest[node] = longest[fail[node]]
        self.step, self.fail, self.ending, self.shorter = step, fail, longest, shorter

    def move(self, node: int, byte: int) -> int:
        """The automaton's next node: the longest prefix of a token that ends with this byte."""
        while (following := self.step.get(node << 8 | byte)) is None and node:
            node = self.fail[node]
        return following or 0

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes: joins the neighbours whose union has the lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(self.bytes_of[token]) == [self.bytes_of[token]]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode to just these two."""
        if (known := self.fits.get(left << 20 | right)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self.fits[left << 20 | right] = self.merge(a + b) == [a, b]
        return known


class IntMap:
    """int64 -> int32 for whole arrays, by open addressing; -1 where a key is absent."""

    def __init__(self, bits: int = 16) -> None:
        self.size, self.bits = 0, bits
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        at, left, mask = self.places(keys), np.arange(len(keys)), len(self.keys) - 1
        while len(left):
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]] = self.values[at[same]]
            on = ~same & (held >= 0)
            left, at = left[on], (at[on] + 1) & mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are absent."""
        self.size += len(keys)
        if 2 * self.size > len(self.keys):
            old = self.keys >= 0
            keys, values = np.r_[self.keys[old], keys], np.r_[self.values[old], values]
            self.bits = max(self.bits + 1, (4 * self.size).bit_length())
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at, left, mask = self.places(keys), np.arange(len(keys)), len(self.keys) - 1
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            mine = free & (self.keys[at] == keys[left])
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & mask


class Together:
    """The same prefix tables for many pieces at once: one numpy step for each byte position and candidate."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.step, self.fits = IntMap(), IntMap()
        self.step.put(np.array(list(vocabulary.step), np.int64), np.array(list(vocabulary.step.values()), np.int32))
        self.fail, self.ending = np.array(vocabulary.fail, np.int32), np.array(vocabulary.ending, np.int32)
        most = max(vocabulary.length, default=0) + 1
        self.length, self.shorter = np.zeros(most, np.int32), np.full(most, -1, np.int32)
        for token, n in vocabulary.length.items():
            self.length[token], self.shorter[token] = n, vocabulary.shorter[token]
        self.stands = np.array([vocabulary.stands(t) if t in vocabulary.bytes_of else False for t in range(most)])

    def moves(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.step.get(node.astype(np.int64) << 8 | byte)
        left = np.flatnonzero((out < 0) & (node > 0))
        while len(left):
            node = node.copy()
            node[left] = self.fail[node[left]]
            out[left] = self.step.get(node[left].astype(np.int64) << 8 | byte[left])
            left = left[(out[left] < 0) & (node[left] > 0)]
        return np.maximum(out, 0)

    def follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = before.astype(np.int64) << 20 | token
        known = self.fits.get(keys)
        if (known < 0).any():
            fresh = np.unique(keys[known < 0])
            if self.fits.size > 1_000_000:
                self.fits = IntMap()
            self.fits.put(fresh, np.array([self.vocabulary.follows(k >> 20, k & (1 << 20) - 1) for k in fresh.tolist()], np.int32))
            self.vocabulary.fits.clear()
            known = self.fits.get(keys)
        return known > 0

    def tokens(self, pieces: list[bytes]) -> list[list[int]]:
        """The encoding of each piece (none is empty)."""
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        size = np.array([len(pieces[k]) for k in order])
        data = np.zeros((len(pieces), size[0]), np.uint8)
        for row, k in enumerate(order):
            data[row, : size[row]] = np.frombuffer(pieces[k], np.uint8)
        last = np.full(data.shape, -1, np.int32)
        node = np.zeros(len(pieces), np.int32)
        for end in range(size[0]):
            rows = np.arange(np.searchsorted(-size, -end))  # the longer ones come first
            node = self.moves(node[: len(rows)], data[: len(rows), end].astype(np.int64))
            token = self.ending[node]
            while len(rows):
                if (token < 0).any():
                    raise KeyError("a byte has no token; the ranks aren't a whole BPE vocabulary")
                before = end - self.length[token]
                ok = self.stands[token] & (before < 0)
                inner = np.flatnonzero(before >= 0)
                ok[inner] = self.follow(last[rows[inner], before[inner]], token[inner])
                last[rows[ok], end] = token[ok]
                rows, token = rows[~ok], self.shorter[token[~ok]]
        out: list[list[int]] = [[] for _ in pieces]
        at, rows = size.copy(), np.arange(len(pieces))
        while len(rows):
            token = last[rows, at[rows] - 1]
            for row, t in zip(rows.tolist(), token.tolist(), strict=True):
                out[order[row]].append(t)
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        return [x[::-1] for x in out]


class PrefixTable:
    """The encoding of one piece that grows: ``last[i]`` is the last token of its first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last, self.node = vocabulary, bytearray(), [], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: no entry changes, one is added for each byte."""
        v, last, node = self.vocabulary, self.last, self.node
        step, ending, shorter, length, fits = v.step, v.ending, v.shorter, v.length, v.fits
        end = len(self.data)
        self.data += more
        for byte in more:
            end += 1
            node = step.get(node << 8 | byte) or v.move(node, byte)
            token = ending[node]
            while token >= 0:
                n = length[token]
                if n == end:
                    if v.stands(token):
                        break
                else:
                    before = last[end - n - 1]
                    known = fits.get(before << 20 | token)
                    if v.follows(before, token) if known is None else known:
                        break
                token = shorter[token]
            if token < 0:
                raise KeyError(f"no token ends with byte {byte} here; the ranks aren't a whole BPE vocabulary")
            last.append(token)
        self.node = node

    def cut(self, length: int) -> None:
        """Forgets all but the first bytes: what an edit at ``length`` leaves valid."""
        del self.data[length:], self.last[length:]
        self.node = 0
        for byte in self.data[-self.vocabulary.longest :]:
            self.node = self.vocabulary.move(self.node, byte)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(token := self.last[at - 1])
            at -= self.vocabulary.length[token]
        return out[::-1]


#: Fixed value: the pattern whose pieces ``Splitter`` finds with numpy. Other patterns are split by the regex library.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER, NEW = range(5)


class Splitter:
    """Piece boundaries of many texts at once. With the known pattern, pieces are runs of one class (letters, numbers,
    spaces, others); a run takes one blank before it; a run of spaces before something else ends one character
    early; and an apostrophe without a blank before it takes a known ending from the letters after it."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.known = pattern == KNOWN
        self.kinds = [regex.compile(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
        self.kind = np.full(0x110000, NEW, np.uint8)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        kind = self.kind[codes]
        if (kind == NEW).any():
            for c in np.unique(codes[kind == NEW]).tolist():
                self.kind[c] = next((k for k, x in enumerate(self.kinds) if x.match(chr(c))), OTHER)
            kind = self.kind[codes]
        return kind

    def starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(byte offsets of all pieces' starts in the joined texts, byte offsets of the texts and their end, joined UTF-8)."""
        joined = "".join(texts)
        data = joined.encode()
        ends = np.cumsum([0, *map(len, texts)])
        if not self.known:
            at = [m.start() + first for t, first in zip(texts, ends[:-1].tolist(), strict=True) for m in self.pattern.finditer(t)]
            marks = np.zeros(len(joined) + 1, bool)
            marks[at] = True
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if self.known:
            marks = self.marks(codes, ends)
        width = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int64)
        byte = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(width, out=byte[1:])
        return byte[np.flatnonzero(marks[:-1])], byte[ends], data

    def marks(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which code points begin a piece (one more at the end)."""
        n = len(codes)
        marks = np.zeros(n + 1, bool)
        if not n:
            return marks
        kind = self.classes(codes)
        first = np.zeros(n + 1, bool)
        first[ends] = True
        marks[1:n] = kind[1:] != kind[:-1]
        marks |= first
        run = np.flatnonzero(marks[:n])
        end = np.r_[run[1:], n]
        before = (kind[run] == SPACE) & ~first[end]  # spaces before something else of the same text
        last = end[before] - 1
        blank = codes[last] == 32
        marks[last[blank] + 1] = False  # the blank goes with what follows
        marks[last] = True
        quote = (kind[run] == OTHER) & (end - run == 1) & (codes[run] == 39) & ~first[end]
        quote &= first[run] | (codes[np.maximum(run - 1, 0)] != 32)
        for r, e in zip(run[quote].tolist(), end[quote].tolist(), strict=True):
            if kind[e] == LETTER:
                for x in ENDINGS:
                    k = len(x)
                    if e + k <= n and not first[e + 1 : e + k].any() and all(codes[e + i] == ord(c) for i, c in enumerate(x)):
                        marks[e], marks[e + k] = False, True
                        break
        return marks


class Encoder:
    """Whole texts: each match of the pattern is a piece of its own. Pieces seen are kept, by a 63-bit hash, with their bytes and ids; a hit counts if its bytes are equal."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.splitter = vocabulary, Splitter(pattern)
        self.split = self.splitter.pattern.findall
        self.together, self.hasher = Together(vocabulary), Hasher()
        tokens = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of, default=0) + 1)]
        self.texts = Slices(tokens)
        self.names = Slices([b"%d," % i for i in range(len(tokens))])
        self.forget()

    def forget(self) -> None:
        self.places = IntMap()
        self.ids, self.kept = Grown(np.int32), Grown(np.uint8)
        self.offsets, self.begins = Grown(np.int64), Grown(np.int64)  # of ids and of kept bytes
        self.offsets.add(np.zeros(1, np.int64))
        self.begins.add(np.zeros(1, np.int64))

    def piece(self, data: bytes) -> list[int]:
        token = self.vocabulary.ranks.get(data)  # as the library does, a piece that is a token is that token
        return [token] if token is not None else PrefixTable(self.vocabulary, data).tokens()

    def learn(self, datas: list[bytes], hashes: np.ndarray | None) -> None:
        """Keeps pieces; without hashes they aren't found again."""
        short = [k for k, d in enumerate(datas) if len(d) <= LONGEST and d not in self.vocabulary.ranks]
        found: list[list[int]] = [[] for _ in datas]
        for k, ids in zip(short, self.together.tokens([datas[k] for k in short]) if short else (), strict=True):
            found[k] = ids
        for k, d in enumerate(datas):
            found[k] = found[k] or self.piece(d)
        if hashes is not None:
            self.places.put(hashes, np.arange(len(self.offsets) - 1, len(self.offsets) - 1 + len(datas), dtype=np.int32))
        self.begins.add(len(self.kept) + np.cumsum([len(d) for d in datas]))
        self.kept.add(np.frombuffer(b"".join(datas), np.uint8))
        self.ids.add(np.fromiter((i for x in found for i in x), np.int32))
        self.offsets.add(len(self.ids) - sum(map(len, found)) + np.cumsum([len(x) for x in found]))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last end)."""
        starts, bounds, data = self.splitter.starts(texts)
        ends = np.r_[starts[1:], len(data)][: len(starts)].astype(np.int64)
        sizes, flat = ends - starts, np.frombuffer(data, np.uint8)
        hashes = (self.hasher.runs(flat, sizes) >> np.uint64(1)).astype(np.int64)
        if len(self.ids) > MEMORY:
            self.forget()
        at = self.places.get(hashes)
        if (at < 0).any():
            missing = np.flatnonzero(at < 0)
            fresh, one = np.unique(hashes[missing], return_index=True)
            rows = missing[one]
            self.learn([data[a:z] for a, z in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)], fresh)
            at = self.places.get(hashes)
        if len(at):
            begins, kept = self.begins.view(), self.kept.view()
            spots = np.minimum(np.repeat(begins[at] - starts, sizes) + np.arange(len(flat)), len(kept) - 1)
            unlike = begins[at + 1] - begins[at] != sizes
            unlike[np.searchsorted(starts, np.flatnonzero(kept[spots] != flat), side="right") - 1] = True
            if unlike.any():  # other pieces of the same hash
                other = np.flatnonzero(unlike)
                at[other] = np.arange(len(self.offsets) - 1, len(self.offsets) - 1 + len(other))
                self.learn([data[a:z] for a, z in zip(starts[other].tolist(), ends[other].tolist(), strict=True)], None)
        offsets = self.offsets.view()
        ids, counts = gathered(self.ids.view(), offsets[at], offsets[at + 1] - offsets[at])
        total = np.r_[0, np.cumsum(counts)]
        return ids, total[np.searchsorted(starts, bounds)]

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for first, last in chunks(texts, GROUP):
            ids, bounds = self.encode_all(texts[first:last])
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[a:z]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text])).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.texts.join(np.fromiter(ids, np.int64))[0].tobytes()


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` one after another, and their sizes."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - first, sizes) + np.arange(total)], sizes


class Slices:
    """Byte strings in one array."""

    def __init__(self, parts: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def join(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the strings at these places, one after another; where each begins and the last ends)."""
        out, sizes = gathered(self.flat, self.start[at], self.size[at])
        return out, np.r_[0, np.cumsum(sizes)]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.data, self.used = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.used

    def add(self, more: np.ndarray) -> None:
        if self.used + len(more) > len(self.data):
            data = np.zeros(max(2 * len(self.data), self.used + len(more)), self.data.dtype)
            data[: self.used] = self.data[: self.used]
            self.data = data
        self.data[self.used : self.used + len(more)] = more
        self.used += len(more)

    def view(self) -> np.ndarray:
        return self.data[: self.used]


class EditableText:
    """A text with its encoding, kept exact through appends and edits by re-encoding near them only."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder = encoder
        self.pieces = encoder.split(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def append(self, more: str) -> None:
        self.edit(sum(map(len, self.pieces)), 0, more)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters at ``at``. Splitting starts two pieces earlier (a run of spaces looks ahead)
        and stops as soon as it meets an old boundary two pieces in a row beyond the edit."""
        first, begin = 0, 0
        while first < len(self.pieces) and begin + len(self.pieces[first]) < at:
            begin += len(self.pieces[first])
            first += 1
        for _ in range(2):
            if first:
                first -= 1
                begin -= len(self.pieces[first])
        old = self.pieces[first:]
        tail = "".join(old)
        fresh = tail[: at - begin] + inserted + tail[at - begin + removed :]
        bounds, pos = {}, 0  # old boundary beyond the edit, counted from the end -> index in old
        for k, p in enumerate(old):
            if pos >= at - begin + removed:
                bounds[len(tail) - pos] = k
            pos += len(p)
        out, pos, met = [], 0, 0
        for m in self.encoder.splitter.pattern.finditer(fresh):
            if pos > at - begin + len(inserted) and len(fresh) - pos in bounds:
                met += 1
                if met == 2:
                    out += old[bounds[len(fresh) - pos] :]
                    break
            else:
                met = 0
            out.append(m[0])
            pos = m.end()
        self.pieces[first:] = out

    def ids(self) -> list[int]:
        return [x for p in self.pieces for x in self.encoder.piece(p.encode())]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Every row with all its columns and, after them, n_tokens, ids_sha256, decoded_sha256 (names behind ``prefix``).

    The vocabulary, a file of bounded size, is broadcast from the driver. Each partition is encoded as
    a stream; nothing is shuffled.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kept = docs.columns
    names = [f"{prefix}{n}" for n in ("n_tokens", "ids_sha256", "decoded_sha256")]
    unclashing(docs, *names)
    rows = docs.select("*", F.col(text_col).cast("string").alias(*free(docs, "_text")))
    at = len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(ranks.value), pattern)  # of this task alone: later stages need the worker's memory
        for b in batches:
            counts, ids, back = [], [], []
            texts = as_texts(b.column(at))
            for first, last in chunks(texts, GROUP):
                found, bounds = encoder.encode_all(texts[first:last])
                written, name_at = encoder.names.join(found)
                plain, plain_at = encoder.texts.join(found)
                for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                    counts.append(z - a)
                    ids.append(hashlib.sha256(written[name_at[a] : max(name_at[a], name_at[z] - 1)]).hexdigest())
                    back.append(hashlib.sha256(plain[plain_at[a] : plain_at[z]]).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [*kept, *names])

    types = [f"`{c}` {t}" for c, t in docs.dtypes]
    return rows.mapInArrow(run, ", ".join([*types, f"`{names[0]}` long", f"`{names[1]}` string", f"`{names[2]}` string"]))
