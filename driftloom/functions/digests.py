"""Canonical framing and SHA-256 digests.

frame(b) is the length of b as eight big-endian bytes, then b. Domains keep digests of different things
apart; they are parameters, since they are part of the hash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = "driftloom:v2"


def be64(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def frame(value: Column) -> Column:
    b = value.cast("binary")
    return F.concat(be64(F.octet_length(b)), b)


def framed(text: str) -> Column:
    return frame(F.lit(text))


def count_frame(n: Column) -> Column:
    return frame(be64(n))


def optional(value: Column) -> Column:
    """frame(00) for null, frame(01) and the framed value otherwise."""
    return F.when(value.isNull(), frame(F.unhex(F.lit("00")))).otherwise(F.concat(frame(F.unhex(F.lit("01"))), frame(value)))


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def entry_digest(canonical: Column, domain: str = DOMAIN) -> Column:
    return digest(F.concat(framed(f"{domain}:entry"), frame(canonical)))


def joined(frames: Column) -> Column:
    """An array of binary, as one binary."""
    return F.unhex(F.array_join(F.transform(frames, lambda b: F.hex(b)), ""))


def lines_digest(lines: Column, domain: str = DOMAIN, policy: str = "exact_lines_v1") -> Column:
    """Digest of a snippet's normalised lines (one character for each byte)."""
    each = joined(F.transform(lines, lambda x: frame(F.encode(x, "ISO-8859-1"))))
    return digest(F.concat(framed(f"{domain}:code"), framed(policy), count_frame(F.size(lines)), each))


def packed(text: Column) -> Column:
    """Text as bytes, two lower-case hexadecimal characters in each where it has no others: half the size on its way. ``unpacked`` gives it back."""
    raw = F.unhex(text)
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.lit(b"\x00"), raw)).otherwise(F.concat(F.lit(b"\x01"), text.cast("binary")))


def unpacked(value: Column) -> Column:
    rest = F.substring(value, 2, 2**31 - 2)
    return F.when(F.substring(value, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
