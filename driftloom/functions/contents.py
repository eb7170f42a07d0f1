"""Contents as lines. Bytes are read as ISO-8859-1, which maps every byte to one character and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(content: Column) -> Column:
    """Binary content as a string, one character for each byte."""
    return F.decode(content, "ISO-8859-1")


def bytes_of(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def lines(text: Column) -> Column:
    """Normalised lines: CRLF becomes LF, one final terminator is dropped, empty content has no lines; all else stays."""
    unified = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    body = F.when(F.endswith(unified, F.lit("\n")), F.left(unified, F.length(unified) - 1)).otherwise(unified)
    return F.when(text.isNull(), F.lit(None)).when(unified == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def escaped(text: Column, limit: int = 256) -> Column:
    """The first bytes of a line with control and non-ASCII characters written as escapes. The line is one character for each byte."""
    head = F.split(F.left(text, F.lit(limit)), "")
    known = {"\t": "\\t", "\r": "\\r", "\n": "\\n", "'": "\\'", '"': '\\"', "\\": "\\\\"}

    def one(c: Column) -> Column:
        out = F.when(F.ascii(c).between(32, 126), c).otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.encode(c, "ISO-8859-1")), 2, "0"))))
        for plain, written in known.items():
            out = F.when(c == plain, written).otherwise(out)
        return out

    return F.array_join(F.transform(head, one), "")
