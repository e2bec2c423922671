"""Flat view: a text is a run of bytes, addressed by offset. ``docs``: (doc_id, content BINARY).

Null contents count as no text: no hits, no bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.bytes import count_overlapping, holds, offsets, slice_bytes
from tessella.sources.corpus import SENTINEL


def extract(docs: DataFrame, offset: int, length: int, wrap: bool = False) -> DataFrame:
    """(doc_id, data): ``length`` bytes from ``offset``. What lies past the end is left out,
    or, with ``wrap``, read on cyclically: the sentinel byte, then from byte 0 again."""
    if offset < 0 or length < 0:
        raise ValueError("offset and length must not be negative")
    c = F.col("content").cast("binary")
    if wrap:
        ring = F.concat(c, F.lit(SENTINEL))
        turns = F.ceil((F.lit(offset + length)) / F.octet_length(ring)).cast("int")
        data = F.when(F.lit(offset) <= F.octet_length(c), slice_bytes(F.encode(F.repeat(F.decode(ring, "ISO-8859-1"), turns), "ISO-8859-1"), offset, length))
    else:
        data = slice_bytes(c, offset, length)
    return docs.select("doc_id", F.coalesce(data, F.lit(b"")).alias("data"))


def count(docs: DataFrame, pattern: str | bytes) -> DataFrame:
    """One row, n: occurrences in all texts, overlapping ones too."""
    hit = docs.where(holds(F.col("content"), pattern))
    return hit.agg(F.coalesce(F.sum(count_overlapping(F.col("content"), pattern)), F.lit(0).cast("long")).alias("n"))


def count_by_doc(docs: DataFrame, pattern: str | bytes) -> DataFrame:
    """(doc_id, n), texts without occurrences too."""
    return docs.select("doc_id", F.coalesce(count_overlapping(F.col("content"), pattern), F.lit(0).cast("long")).alias("n"))


def search(docs: DataFrame, pattern: str | bytes) -> DataFrame:
    """(doc_id, off): offsets of all occurrences. Nothing is shuffled."""
    hit = docs.where(holds(F.col("content"), pattern))
    return hit.select("doc_id", F.explode(offsets(F.col("content"), pattern)).alias("o")).select("doc_id", F.explode("o").alias("off"))
