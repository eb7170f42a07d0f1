"""SentencePiece encoding and decoding (merge type with byte fallback), exactly, by backtracking.

A sequence of pieces is the encoding of a text exactly if each piece's own characters merge to it and
each two neighbours, merged again from their characters, give back just these two: until a merge
crosses a boundary, both sides evolve as they would alone. So the encoder walks from left to right
over the longest piece at each place (found for all places by one Aho-Corasick pass), checks it
against the piece before it, tries shorter ones, and steps back where none is left. The pieces before
a place are the only encoding of what lies before it; so a place that can't be continued is never
tried again. One bit for each place remembers that, and the walk is linear in the text.

Characters without a piece become their UTF-8 bytes' pieces. No piece holds a blank after something
else, so no merge crosses the place before a blank: a text is cut there, and the pieces of cut units
are remembered within a task.

Null text counts as empty: the begin and end ids alone. Bytes that aren't UTF-8 become U+FFFD, one
for each byte. Texts of any length are encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_bytes, free, unclashing

#: The character that stands for a blank.
BLANK = "▁"
#: Fixed values of the model format: kinds of pieces, and the merge type of models.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2
#: Units that a task remembers (a full memory is emptied), the longest of them, and pairs of pieces.
UNITS, LONGEST, PAIRS = 400_000, 64, 1_000_000


def one_by_one(error: UnicodeError) -> tuple[str, int]:
    """Decoding errors: U+FFFD for a single byte, then on with the next one."""
    return "\ufffd", error.start + 1


def text_of(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        codecs.register_error("driftloom.byte", one_by_one)
        return data.decode(errors="driftloom.byte")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """A model file's pieces. ``lost``: ids of pieces that their own characters don't merge to; found here unless given."""

    def __init__(self, data: bytes, lost: frozenset[int] | None = None) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        if trainer.get(3) != MERGES or not trainer.get(35) or trainer.get(24) or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only merge models with byte fallback, without character maps and removal of blanks, are read")
        if other := {k for _, _, k in self.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"pieces of kinds {sorted(other)} aren't read")
        self.dummy = bool(rules.get(3, 1))
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.score = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.bytes = [0] * 256
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.characters = set("".join(self.ids))
        if self.characters - self.ids.keys():
            raise ValueError("a piece has a character without a piece of its own")
        self.lost = frozenset(i for p, i in self.ids.items() if self.merge(p) != [p]) if lost is None else lost
        self.standing = {p: i for p, i in self.ids.items() if i not in self.lost}
        self.length = {i: len(p) for p, i in self.ids.items()}
        self.shorter = {i: next((self.standing[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.standing), -1) for p, i in self.standing.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.standing.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging of a few characters: the neighbours whose union has the highest score, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            found = [score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(found)
            if best == -np.inf:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether the characters of both pieces together merge to just these two."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            a, b = self.pieces[left][0], self.pieces[right][0]
            known = self.fits[left, right] = self.merge(a + b) == [a, b]
        return known

    def encode(self, unit: str) -> list[int]:
        """Ids of a text whose blanks are replaced already."""
        longest = [-1] * len(unit)
        for last, i in self.automaton.iter(unit):
            longest[last + 1 - self.length[i]] = i  # ends ascend, so the longest stays
        out: list[int] = []
        at = 0
        for place in [k for k, i in enumerate(longest) if i < 0] + [len(unit)]:
            if at < place:
                out += self.walk(longest, at, place)
            if place < len(unit):
                out += [self.bytes[b] for b in unit[place].encode()]
            at = place + 1
        return out

    def walk(self, longest: list[int], first: int, last: int) -> list[int]:
        """The only sequence of pieces over these places, each of which has a piece."""
        length, shorter, fits = self.length, self.shorter, self.fits
        failed = bytearray((last - first >> 3) + 1)
        held: list[int] = []
        at, i = first, longest[first]
        while at < last:
            while i >= 0:
                to = at + length[i]
                bit = to - first
                if to <= last and not failed[bit >> 3] >> (bit & 7) & 1:
                    if not held:
                        break
                    known = fits.get((held[-1], i))
                    if self.follows(held[-1], i) if known is None else known:
                        break
                i = shorter[i]
            if i >= 0:
                held.append(i)
                at = to
                i = longest[at] if at < last else -1
            else:
                bit = at - first
                failed[bit >> 3] |= 1 << (bit & 7)
                i = held.pop()  # the first place never fails: every text has an encoding
                at -= length[i]
                i = shorter[i]
        return held


class Units(dict):
    """Unit of text -> its ids as bytes."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, unit: str) -> bytes:
        ids = np.array(self.model.encode(unit), "<u4").tobytes()
        if len(unit) <= LONGEST:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = ids
        return ids


class Processor:
    """Encodes and decodes whole texts. Ids are bytes: little-endian unsigned 32-bit integers."""

    def __init__(self, model: Model) -> None:
        self.model, self.units = model, Units(model)
        free_start = not any(BLANK in p.lstrip(BLANK) for p in model.ids)
        line = "" if "\n" in model.characters else "\n"  # a character without a piece stands alone
        cut = f"{BLANK}+[^{BLANK}{line}]*|[^{BLANK}{line}]+" + ("|\n" if line else "")
        self.split = re.compile(cut).findall if free_start else lambda text: [text]
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        values = {i: bytes([b]) for b, i in enumerate(model.bytes)}
        self.values = [p.replace(BLANK, " ").encode() if k == NORMAL else values.get(i, b"") for i, (p, _, k) in enumerate(model.pieces)]
        for i, (_, _, kind) in enumerate(model.pieces):
            if kind == UNKNOWN:
                self.values[i] = " ⁇ ".encode()

    def encode(self, text: str) -> bytes:
        """With begin and end ids."""
        if not text:
            return self.begin + self.end
        text = text.replace(" ", BLANK)
        return self.begin + b"".join(map(self.units.__getitem__, self.split(BLANK + text if self.model.dummy else text))) + self.end

    def decode(self, ids: bytes) -> str:
        """Control ids have no text; the blank put before the first word goes."""
        found = np.frombuffer(ids, "<u4").tolist()
        out = b"".join(map(self.values.__getitem__, found))
        if self.model.dummy:
            first = next((i for i in found if self.model.pieces[i][2] != CONTROL), None)
            if first is not None and self.model.pieces[first][2] == NORMAL and out.startswith(b" "):
                out = out[1:]
        return text_of(out)


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Every row with all its columns and, after them, n_tokens, ids_sha256, decoded_sha256 (names behind ``prefix``).

    The model file, of bounded size, is broadcast from the driver as bytes. Each partition is encoded
    as a stream; nothing is shuffled. An empty table gives no rows, repeated rows equal results; a
    column of docs with one of the result's names is an error.
    """
    with open(model_path, "rb") as file:
        data = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((data, Model(data).lost))
    kept = docs.columns
    names = [f"{prefix}{n}" for n in ("n_tokens", "ids_sha256", "decoded_sha256")]
    unclashing(docs, *names)
    rows = docs.select("*", F.col(text_col).cast("string").cast("binary").alias(*free(docs, "_text")))
    at = len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = Processor(Model(*shared.value))
        for b in batches:
            counts, digests, back = [], [], []
            for text in as_bytes(b.column(at)):
                ids = processor.encode(text_of(text))
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(processor.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], [*kept, *names])

    types = [f"`{c}` {t}" for c, t in docs.dtypes]
    return rows.mapInArrow(run, ", ".join([*types, f"`{names[0]}` long", f"`{names[1]}` string", f"`{names[2]}` string"]))
