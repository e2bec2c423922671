"""Byte-exact column functions.

Offsets and lengths count bytes from 0. The one-byte view of a binary column (ISO
8859-1) maps each byte to one character, so the engine's string functions work on
bytes there, and stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that one step of a search looks at.
BLOCK = 4096


def as_bytes(text: str | bytes) -> bytes:
    """A pattern as bytes; empty ones are an error."""
    out = text.encode("utf-8") if isinstance(text, str) else bytes(text)
    if not out:
        raise ValueError("the pattern is empty")
    return out


def view(content: Column) -> Column:
    """One character per byte."""
    return F.decode(content.cast("binary"), "ISO-8859-1")


def quoted(pattern: str | bytes) -> str:
    """A Java pattern for the bytes, literally, over the one-byte view."""
    return "".join(f"\\x{b:02x}" for b in as_bytes(pattern))


def holds(content: Column, pattern: str | bytes) -> Column:
    """Whether the bytes occur."""
    return F.contains(content.cast("binary"), F.lit(as_bytes(pattern)))


def count_overlapping(content: Column, pattern: str | bytes) -> Column:
    """Number of occurrences, overlapping ones too."""
    n = F.regexp_count(view(content), F.lit(f"(?={quoted(pattern)})")).cast("long")
    return F.when(holds(content, pattern), n).otherwise(F.lit(0).cast("long"))


def slice_bytes(content: Column, offset, length) -> Column:
    """Bytes [offset, offset + length), as far as there are any; none for a negative length."""
    offset, length = (x if isinstance(x, Column) else F.lit(x) for x in (offset, length))
    c = content.cast("binary")
    size = F.greatest(F.lit(0).cast("long"), F.least(length.cast("long"), F.octet_length(c) - offset.cast("long")))
    return F.substring(c, (offset.cast("long") + 1).cast("int"), size.cast("int"))


def offsets(content: Column, pattern: str | bytes) -> Column:
    """Array of arrays of the offsets of all occurrences, by block: explode twice.

    The lengths of the pieces between zero-width splits add up to offsets. They are
    summed block by block, so a text with many hits costs no more than its length.
    """
    p = as_bytes(pattern)
    c = content.cast("binary")
    ahead = f"(?={quoted(p)})"

    def block(start: Column) -> Column:
        part = view(F.substring(c, (start + 1).cast("int"), F.lit(BLOCK + len(p) - 1)))
        # a zero-width split keeps no empty piece at the front: a sentinel character makes every hit start a piece
        sizes = F.transform(F.split(F.concat(F.lit("Ā"), part), ahead, -1), F.length)
        total = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.when(F.size(a) > 0, F.get(a, F.size(a) - 1)).otherwise(F.lit(-1)) + n)))
        return F.transform(total, lambda n: start + n.cast("long"))

    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.octet_length(c).cast("long") - 1), F.lit(BLOCK).cast("long"))
    return F.when(holds(c, p), F.transform(starts, block))
