"""Suffix order of texts: SA, ISA, NPA, characters and pattern ranges as DataFrames.

Each text, its sentinel appended, is ordered on its own, so texts run in parallel.
Up to ``DIRECT`` bytes suffixes are sorted as they are; longer texts are ordered by
prefix doubling, whose rounds sort ranks instead of suffixes.
Bytes compare unsigned; the sentinel 0x01 is a byte like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.bytes import as_bytes
from tessella.sources.corpus import SENTINEL
from tessella.sources.storage import written

DIRECT = 4096


def _ring(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.col("content").cast("binary"), F.lit(SENTINEL)).alias("c"))


def suffix_array(docs: DataFrame, direct: int = DIRECT) -> DataFrame:
    """(doc_id, idx, sa): the start of the idx-th suffix."""
    longest = docs.agg(F.max(F.octet_length("content"))).first()[0] or 0
    at = F.posexplode(F.sequence(F.lit(0), F.octet_length("c") - 1)).alias("sa", "x")
    if longest <= direct:
        rows = _ring(docs).select("doc_id", "c", at).select("doc_id", F.col("sa").cast("long").alias("sa"), F.substring("c", F.col("sa") + 1, F.octet_length("c")).alias("suffix"))
        idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("suffix")) - 1
        return rows.select("doc_id", idx.cast("long").alias("idx"), "sa")
    ranks = _ring(docs).select("doc_id", "c", at).select("doc_id", F.col("sa").cast("long").alias("pos"), F.conv(F.hex(F.substring("c", F.col("sa") + 1, F.lit(1))), 16, 10).cast("long").alias("rank"))
    k = 1
    while True:
        shifted = ranks.select("doc_id", (F.col("pos") - k).alias("pos"), F.col("rank").alias("next"))
        pairs = ranks.join(shifted, ["doc_id", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long")))
        new = pairs.select("doc_id", "pos", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("rank", "next")).cast("long").alias("rank"))
        ranks = written(new)  # cuts the lineage, which would double each round
        k *= 2
        if k > longest or ranks.groupBy("doc_id").agg((F.max("rank") < F.count("*")).alias("open")).where("open").isEmpty():
            break
    return ranks.select("doc_id", (F.col("rank") - 1).alias("idx"), F.col("pos").alias("sa"))


def inverse(sa: DataFrame) -> DataFrame:
    """(doc_id, pos, isa): the rank of the suffix at pos."""
    return sa.select("doc_id", F.col("sa").alias("pos"), F.col("idx").alias("isa"))


def next_pointers(sa: DataFrame) -> DataFrame:
    """(doc_id, idx, npa): the rank of the suffix one byte on, cyclically."""
    n = sa.groupBy("doc_id").agg(F.count("*").alias("n"))
    ahead = sa.join(n, "doc_id").select("doc_id", "idx", F.pmod(F.col("sa") + 1, F.col("n")).alias("pos"))
    return ahead.join(inverse(sa), ["doc_id", "pos"]).select("doc_id", "idx", F.col("isa").alias("npa"))


def alphabet(docs: DataFrame) -> DataFrame:
    """(doc_id, char_id, byte, first_row): distinct bytes in order and the first suffix that starts with each."""
    bytes_ = _ring(docs).select("doc_id", F.explode(F.split(F.decode("c", "ISO-8859-1"), "(?s)(?<=.)(?=.)", -1)).alias("b"))
    counts = bytes_.groupBy("doc_id", F.encode("b", "ISO-8859-1").alias("byte")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("byte")
    first = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return counts.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("char_id"), "byte", first.alias("first_row"))


def char_ids(docs: DataFrame, sa: DataFrame) -> DataFrame:
    """(doc_id, idx, char_id): the character that the idx-th suffix starts with."""
    at = F.conv(F.hex(F.substring("c", (F.col("sa") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    letters = alphabet(docs).select("doc_id", "char_id", F.conv(F.hex("byte"), 16, 10).cast("int").alias("b"))
    return sa.join(_ring(docs), "doc_id").select("doc_id", "idx", at.alias("b")).join(letters, ["doc_id", "b"]).select("doc_id", "idx", "char_id")


def char_at(docs: DataFrame, pos: int) -> DataFrame:
    """(doc_id, byte) at an offset; empty past the end."""
    return _ring(docs).select("doc_id", F.substring("c", pos + 1, 1).alias("byte"))


def pattern_range(docs: DataFrame, sa: DataFrame, pattern: str | bytes) -> DataFrame:
    """(doc_id, first, last): the rows of the suffixes that start with the pattern; 0 and -1 where none does."""
    p = as_bytes(pattern)
    starts = F.substring("c", (F.col("sa") + 1).cast("int"), F.lit(len(p))) == F.lit(p)
    rows = sa.join(_ring(docs), "doc_id").groupBy("doc_id").agg(F.min(F.when(starts, F.col("idx"))).alias("lo"), F.max(F.when(starts, F.col("idx"))).alias("hi"))
    return rows.select("doc_id", F.coalesce("lo", F.lit(0).cast("long")).alias("first"), F.coalesce("hi", F.lit(-1).cast("long")).alias("last"))


def _row_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, first, last) of the rows (doc_id, idx) that are left; 0 and -1 where none is."""
    left = rows.groupBy("doc_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return ranges.select("doc_id").join(left, "doc_id", "left").select("doc_id", F.coalesce("lo", F.lit(0).cast("long")).alias("first"), F.coalesce("hi", F.lit(-1).cast("long")).alias("last"))


def continue_backward(docs: DataFrame, sa: DataFrame, ranges: DataFrame, pattern: str | bytes) -> DataFrame:
    """(doc_id, first, last): the range of ``pattern`` followed by what ``ranges(doc_id, first, last)`` matched."""
    p = as_bytes(pattern)
    inside = sa.join(ranges, "doc_id").where("idx between first and last").select("doc_id", (F.col("sa") - len(p)).alias("pos")).where("pos >= 0")
    same = F.substring("c", (F.col("pos") + 1).cast("int"), F.lit(len(p))) == F.lit(p)
    before = inside.join(_ring(docs), "doc_id").where(same).select("doc_id", "pos")
    return _row_range(before.join(inverse(sa), ["doc_id", "pos"]).select("doc_id", F.col("isa").alias("idx")), ranges)


def continue_forward(docs: DataFrame, sa: DataFrame, ranges: DataFrame, matched: int, pattern: str | bytes) -> DataFrame:
    """(doc_id, first, last): the range of the ``matched`` bytes that ``ranges`` stands for, followed by ``pattern``."""
    p = as_bytes(pattern)
    inside = sa.join(ranges, "doc_id").where("idx between first and last").join(_ring(docs), "doc_id")
    same = F.substring("c", (F.col("sa") + matched + 1).cast("int"), F.lit(len(p))) == F.lit(p)
    return _row_range(inside.where(same).select("doc_id", "idx"), ranges)
