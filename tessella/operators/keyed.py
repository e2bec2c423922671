"""Keyed lines: (shard_id, key, value_offset, value BINARY, is_valid), see ``sources.corpus``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.bytes import as_bytes, count_overlapping, holds, offsets, slice_bytes
from tessella.operators import regex
from tessella.plans import regex as syntax

#: Offsets of one block of the offset lookup and of the lookup of later matches, a power of two.
SPAN = 1 << 16
#: Records after its own that a match is looked for in, at most; beyond, a shard's records are one stream.
FOLLOWING = 8
#: Matches of one side of a gap that meet those of the other side at a time.
CHUNK = 4096
#: Partitions that the pairs over a gap are made in, at least: their inputs are too small to tell how many.
PARTS = 64


def get(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) for each row of ``keys(key)``; an absent or invalid key has an empty value."""
    return keys.join(kv.where("is_valid").select("key", "value"), "key", "left").select("key", F.coalesce("value", F.lit(b"")).alias("value"))


def access(kv: DataFrame, keys: DataFrame, offset: int, length: int) -> DataFrame:
    """(key, data): a slice of each value, clamped to its end; empty past it and for absent keys."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    return get(kv, keys).select("key", slice_bytes(F.col("value"), offset, length).alias("data"))


def _one_line(pattern: str | bytes) -> bool:
    return b"\n" not in as_bytes(pattern)


def _across_lines(kv: DataFrame, pattern: str | bytes) -> DataFrame:
    """(shard_id, key, off): occurrences of a pattern with newlines, one at most in a record.

    A value must end with what stands before the first newline, the next ones equal
    what stands between, and one more start with the rest. The next record is the one
    whose offset follows, so each step is an equi-join of rows that pass their filter."""
    head, *middle, tail = as_bytes(pattern).split(b"\n")
    value, size = F.col("value"), F.octet_length("value").cast("long")
    found = kv.where(F.endswith(value, F.lit(head))).select("shard_id", "key", (F.col("value_offset") + size - len(head)).alias("off"), (F.col("value_offset") + size + 1).alias("next"))
    for i, piece in enumerate([*middle, tail]):
        fits = F.startswith(value, F.lit(piece)) if i == len(middle) else value == F.lit(piece)
        after = kv.where(fits).select("shard_id", F.col("value_offset").alias("next"), (F.col("value_offset") + size + 1).alias("then"))
        found = found.join(after, ["shard_id", "next"]).select("shard_id", "key", "off", F.col("then").alias("next"))
    return found.select("shard_id", "key", "off")


def hits(kv: DataFrame, pattern: str | bytes) -> DataFrame:
    """(shard_id, key): records in which an occurrence starts. A pattern with a newline is looked
    for across records of a shard and belongs to the record where it starts."""
    if _one_line(pattern):
        return kv.where(holds(F.col("value"), pattern)).select("shard_id", "key")
    return _across_lines(kv, pattern).select("shard_id", "key")


def search(kv: DataFrame, pattern: str | bytes) -> DataFrame:
    """(key): records in which an occurrence starts, see ``hits``."""
    return hits(kv, pattern).select("key")


def count(kv: DataFrame, pattern: str | bytes) -> DataFrame:
    """One row, n: records in which an occurrence starts."""
    return search(kv, pattern).agg(F.count("*").alias("n"))


def flat_search(kv: DataFrame, pattern: str | bytes) -> DataFrame:
    """(shard_id, off): occurrences in the shard's text, by byte offset."""
    if _one_line(pattern):
        hit = kv.where(holds(F.col("value"), pattern))
        found = hit.select("shard_id", "value_offset", F.explode(offsets(F.col("value"), pattern)).alias("o"))
        return found.select("shard_id", F.explode(F.transform("o", lambda x: x + F.col("value_offset"))).alias("off"))
    return _across_lines(kv, pattern).select("shard_id", "off")


def flat_count(kv: DataFrame, pattern: str | bytes) -> DataFrame:
    """One row, n: occurrences in the shards' texts, overlapping ones too."""
    if not _one_line(pattern):
        return flat_search(kv, pattern).agg(F.count("*").alias("n"))
    return kv.where(holds(F.col("value"), pattern)).agg(F.coalesce(F.sum(count_overlapping(F.col("value"), pattern)), F.lit(0).cast("long")).alias("n"))


def flat_extract(kv: DataFrame, shard_id: int, offset: int, length: int) -> DataFrame:
    """One row, data: a slice of a shard's text. Only records that overlap it are read together."""
    if offset < 0 or length < 0:
        raise ValueError("offset and length must not be negative")
    end = F.col("value_offset") + F.octet_length("value") + 1
    rows = kv.where((F.col("shard_id") == shard_id) & (F.col("value_offset") < offset + length) & (end > offset))
    last = kv.where(F.col("shard_id") == shard_id).agg(F.max("key").alias("last"))
    one = rows.crossJoin(F.broadcast(last)).withColumn("v", F.concat("value", F.when(F.col("key") < F.col("last"), F.lit(b"\n")).otherwise(F.lit(b""))))
    start = F.greatest(F.lit(0).cast("long"), F.lit(offset) - F.col("value_offset"))
    part = slice_bytes(F.col("v"), start, F.lit(offset + length) - F.col("value_offset") - start)
    got = one.select("key", F.decode(part, "ISO-8859-1").alias("p")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "p"))), lambda x: x["p"]), "").alias("p"))
    return got.select(F.encode("p", "ISO-8859-1").alias("data"))


def key_of_offset(kv: DataFrame, at: DataFrame) -> DataFrame:
    """(shard_id, off, key) for each row of ``at(shard_id, off)``: the record whose bytes, its
    newline included, hold the offset; past the end the shard's last one. Null for a
    negative offset and for a shard that isn't there.

    Starts of records and offsets are sorted together in blocks of ``SPAN`` offsets, and
    each offset takes the last start before it. An offset asked for many times is one row
    with a count until its key is known.
    """
    block = lambda c: F.shiftright(c, SPAN.bit_length() - 1)
    asked = at.where("off >= 0").groupBy("shard_id", "off").agg(F.count("*").alias("n"))
    asks = asked.select("shard_id", block(F.col("off")).alias("block"), F.col("off").alias("pos"), F.lit(None).cast("long").alias("key"), "n")
    covered = F.explode(F.sequence(block(F.col("value_offset")), block(F.col("value_offset") + F.octet_length("value").cast("long"))))
    starts = kv.select("shard_id", covered.alias("block"), "value_offset", "key").select("shard_id", "block", F.greatest("value_offset", F.col("block") * SPAN).alias("pos"), "key", F.lit(None).cast("long").alias("n"))
    order = Window.partitionBy("shard_id", "block").orderBy("pos", F.col("n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = starts.union(asks).withColumn("key", F.last("key", ignorenulls=True).over(order)).where("n is not null")
    # blocks past the last record hold no start
    found = found.join(kv.groupBy("shard_id").agg(F.max("key").alias("last")), "shard_id", "left").select("shard_id", F.col("pos").alias("off"), F.coalesce("key", "last").alias("key"), "n")
    each = found.select("shard_id", "off", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPAN).cast("long"))).alias("from"), "n")
    each = each.select("shard_id", "off", "key", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + SPAN) - 1)))
    return each.select("shard_id", "off", "key").union(at.where("off < 0 or off is null").select("shard_id", "off", F.lit(None).cast("long").alias("key")))


def position_of_key(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value_offset): where a key's value starts; -1 for an absent or invalid key."""
    return keys.join(kv.where("is_valid").select("key", "value_offset"), "key", "left").select("key", F.coalesce("value_offset", F.lit(-1).cast("long")).alias("value_offset"))


def num_keys(kv: DataFrame) -> DataFrame:
    return kv.agg(F.count("*").alias("n"))


def search_field(kv: DataFrame, value: str, separator: str = "|") -> DataFrame:
    """(key): records with a whole separated field equal to ``value``, not the first or last one."""
    return search(kv, f"{separator}{value}{separator}")


def regex_search(kv: DataFrame, pattern: str, mode: str = "reference") -> DataFrame:
    """(shard_id, off, len): all matches in the shards' texts, by byte offset.

    Only matches, not texts, meet over a gap."""
    if ".*" not in pattern:
        return _matches(kv, pattern, mode).select("shard_id", "off", "len")
    *_, last = pattern.split(".*")
    return _pairs(_before_last_gap(kv, pattern, mode), _matches(kv, last, mode))


def _matches(kv: DataFrame, pattern: str, mode: str) -> DataFrame:
    """(shard_id, key, off, len) of a pattern without gaps. The newlines that a match can hold tell how many
    records it may go on in: if they are few, records are searched with those after them, each on
    its own; else a shard's records are one stream."""
    (tree,) = syntax.parts(pattern)
    n = syntax.most(tree, 10)
    if n is None or n > FOLLOWING:
        return regex.stream(kv, pattern, mode)
    rows = kv.select("shard_id", "key", "value_offset", "value", (F.octet_length("value") + 1).alias("size"), (F.col("value_offset") + F.octet_length("value") + 1).alias("next"))
    if n and (head := syntax.leading(tree).split(b"\n")[0]):
        rows = rows.where(holds(F.col("value"), head))
    for _ in range(n):
        after = kv.select("shard_id", F.col("value_offset").alias("next"), F.col("value").alias("more"), (F.col("value_offset") + F.octet_length("value") + 1).alias("then"))
        longer = F.coalesce(F.concat("value", F.lit(b"\n"), "more"), "value")
        rows = rows.join(after, ["shard_id", "next"], "left").select("shard_id", "key", "value_offset", longer.alias("value"), "size", F.col("then").alias("next"))
    at = F.struct("shard_id", "key", "value_offset", "size")
    found = regex.search(rows.select(at.alias("doc_id"), F.col("value").alias("content")), pattern, mode)
    # those that start further on are the next record's
    return found.where("off < doc_id.size").select("doc_id.shard_id", "doc_id.key", (F.col("doc_id.value_offset") + F.col("off")).alias("off"), "len")


def _block(position: str) -> Column:
    return F.shiftright(F.col(position), SPAN.bit_length() - 1)


def _before_last_gap(kv: DataFrame, pattern: str, mode: str) -> DataFrame:
    """(shard_id, key, off, end), one row per start: the least end that a match of all but the last
    sub-expression can have. It allows all that the start's other ends allow."""
    first, *middle, _ = pattern.split(".*")
    left = _matches(kv, first, mode).groupBy("shard_id", "key", "off").agg(F.min(F.col("off") + F.col("len")).alias("end"))
    for sub in middle:
        left = _least_later_end(left, _matches(kv, sub, mode))
    return left


def _least_later_end(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the least end of the matches that begin at its end or later; without those that have none.

    Both sides are sorted together, from the last, in blocks of ``SPAN`` offsets; a block starts
    with the least end of the blocks after it."""
    null = F.lit(None).cast("long")
    rows = left.select("shard_id", "key", "off", F.col("end").alias("pos"), null.alias("end")).union(right.select("shard_id", null, null, "off", F.col("off") + F.col("len")))
    rows = rows.withColumn("block", _block("pos"))
    after = Window.partitionBy("shard_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy("shard_id", "block").agg(F.min("end").alias("least"))
    marks = least.select("shard_id", null, null, null, F.min("least").over(after), "block")
    order = Window.partitionBy("shard_id", "block").orderBy(F.desc_nulls_first("pos"), F.asc_nulls_first("off")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.union(marks).withColumn("end", F.min("end").over(order)).where("off is not null and end is not null").select("shard_id", "key", "off", "end")


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(shard_id, off, len), distinct: each start with all ends of the matches that begin at its end or later.

    There may be as many pairs as the product of both sides. So both are dealt by hash into
    chunks of about ``CHUNK`` rows that meet in cells, the ends of a cell as one row, and the
    pairs are made start by start in generated code, which holds one start's at a time.
    Nothing is shuffled but the sides, once for each chunk of the other."""
    starts = left.select("shard_id", "off", "end")
    # of the matches with one end the last to begin follows all that the others follow
    ends = right.groupBy("shard_id", (F.col("off") + F.col("len")).alias("end")).agg(F.max("off").alias("off"))
    sizes = starts.groupBy("shard_id").agg(F.count("end").alias("a")).join(ends.groupBy("shard_id").agg(F.count("off").alias("b")), "shard_id")
    sizes = sizes.select("shard_id", *(F.ceil(F.col(c) / CHUNK).cast("long").alias(c) for c in ("a", "b")))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = lambda side, n: side.join(sizes, "shard_id").withColumn(f"at_{n}", F.pmod(F.xxhash64("off", "end"), n))
    cell, parts = ["shard_id", "at_a", "at_b"], max(PARTS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = dealt(starts, "a").select("shard_id", "at_a", each("b").alias("at_b"), "off", "end").repartition(parts, *cell)
    many = dealt(ends, "b").groupBy("shard_id", "at_b", "a").agg(F.collect_list(F.struct("off", "end")).alias("e"))
    # arrays of numbers: an array of structs makes an object for each pair
    many = many.select("shard_id", each("a").alias("at_a"), "at_b", F.col("e.off").alias("begins"), F.col("e.end").alias("ends")).repartition(parts, *cell)
    # a merge goes by starts; a broadcast of the starts would go by cells and hold all of a cell's pairs
    met = one.join(many.hint("merge"), cell).select("shard_id", "off", "end", "begins", F.posexplode("ends").alias("i", "to"))
    return met.where(F.get("begins", "i") >= F.col("end")).select("shard_id", "off", (F.col("to") - F.col("off")).alias("len"))


def regex_keys(kv: DataFrame, pattern: str, mode: str = "reference") -> DataFrame:
    """(shard_id, key): records in which a match starts, each once."""
    if ".*" not in pattern:
        return _matches(kv, pattern, mode).select("shard_id", "key").distinct()
    *_, sub = pattern.split(".*")
    last = _matches(kv, sub, mode).groupBy("shard_id").agg(F.max("off").alias("last"))
    return _before_last_gap(kv, pattern, mode).join(last, "shard_id").where("end <= last").select("shard_id", "key").distinct()


def regex_count(kv: DataFrame, pattern: str, mode: str = "reference") -> DataFrame:
    """(sub_id, n): matches of each sub-expression between gaps, over all shards."""
    subs = pattern.split(".*")
    if all(syntax.most(t, 10) == 0 for t in syntax.parts(pattern)):
        return regex.count(kv.select(F.col("key").alias("doc_id"), F.col("value").alias("content")), pattern, mode)
    return reduce(DataFrame.union, (_matches(kv, sub, mode).agg(F.lit(i).alias("sub_id"), F.count("*").alias("n")) for i, sub in enumerate(subs)))
