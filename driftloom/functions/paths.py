"""Rules of logical paths and identifiers, as boolean or code columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that some file systems reserve.
RESERVED = ("con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9", "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9", "com¹", "com²", "com³", "lpt¹", "lpt²", "lpt³")
#: Fixed value: the Unicode white space characters, as a regular expression's class.
WHITE = "[\\x09-\\x0d\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def valid(path: Column) -> Column:
    """Nonempty, relative, parts between slashes; no backslash, colon or NUL; no empty, '.' or '..' part."""
    bad = F.contains(path, F.lit("\\")) | F.contains(path, F.lit(":")) | F.contains(path, F.lit("\0"))
    return F.coalesce((path != "") & ~bad & F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", "..")), F.lit(False))


def portable(path: Column) -> Column:
    """Valid, and no part is reserved, ends in a space or full stop, or holds control or wildcard characters."""

    def part(p: Column) -> Column:
        return ~F.lower(F.substring_index(p, ".", 1)).isin(*RESERVED) & ~p.rlike('[\\x00-\\x1f<>"|?*]') & ~p.rlike("[ .]$")

    return valid(path) & F.forall(F.split(path, "/"), part)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_fault(name: Column) -> Column:
    """Null for a good identifier, else the first rule it breaks: empty, surrounding_whitespace, too_long, control_character."""
    return (
        F.when(name.rlike("\\A[!-~]{1,256}\\z"), F.lit(None).cast("string"))  # most names: no white space or control character to look for
        .when(name.isNull() | (name == ""), "empty")
        .when(name.rlike(f"^{WHITE}|{WHITE}$"), "surrounding_whitespace")
        .when(F.octet_length(name) > 256, "too_long")
        .when(name.rlike("[\\x00-\\x1f\\x7f-\\x{9f}]"), "control_character")
    )


def root_documents(path: Column) -> Column:
    """Paths of contract documents: no folder, extension yml or yaml in any case."""
    return ~F.contains(path, F.lit("/")) & F.lower(path).rlike("\\.ya?ml$")


def item_id(crate: Column, modules: Column, kind: Column, name: Column, occurrence: Column) -> Column:
    """An item's identity as text with length-prefixed fields."""
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    parts = F.array_join(F.transform(modules, lambda m: F.concat(F.lit(":"), sized(m))), "")
    number = occurrence.cast("string")
    return F.concat(F.lit("rust:v2:crate:"), sized(crate), F.lit(":modules:"), F.size(modules).cast("string"), parts, F.lit(":kind:"), sized(kind), F.lit(":name:"), sized(name), F.lit(":occurrence:"), sized(number))
