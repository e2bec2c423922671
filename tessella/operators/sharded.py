"""Shards: per-shard results and how they merge.

A shard is a column, so scatter and gather are one plan: scan, partial result per
shard, merge.  Flat offsets are global by a running sum of the shards' sizes; a
keyed record's global key is ``shard_id * 2^32 + key``.  Occurrences never cross
shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.bytes import slice_bytes
from tessella.operators import flat, keyed
from tessella.operators import regex as matcher

KEY_BITS = 32


def pack(shard: Column, key: Column) -> Column:
    return F.shiftleft(shard.cast("long"), KEY_BITS) + key.cast("long")


def shard_of(key: Column) -> Column:
    return F.shiftright(key.cast("long"), KEY_BITS)


def local_of(key: Column) -> Column:
    return key.cast("long").bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def bases(shards: DataFrame) -> DataFrame:
    """(doc_id, base, size) of flat shards, sentinel included. One row per shard meets in one window: shards are files, not rows."""
    sizes = shards.select("doc_id", (F.octet_length("content").cast("long") + 1).alias("size"))
    before = F.sum("size").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("doc_id", F.coalesce(before, F.lit(0).cast("long")).alias("base"), "size")


def count(shards: DataFrame, pattern: str | bytes) -> DataFrame:
    """One row, n: the sum of the shards' counts."""
    return flat.count(shards, pattern)


def search(shards: DataFrame, pattern: str | bytes) -> DataFrame:
    """(doc_id, off): global offsets."""
    found = flat.search(shards, pattern)
    return found.join(bases(shards), "doc_id").select("doc_id", (F.col("off") + F.col("base")).alias("off"))


def extract(shards: DataFrame, offset: int, length: int) -> DataFrame:
    """One row at most, (doc_id, data): from the shard that holds the global offset, not across its end."""
    at = bases(shards).where((F.col("base") <= offset) & (F.lit(offset) < F.col("base") + F.col("size")))
    return shards.join(F.broadcast(at), "doc_id").select("doc_id", slice_bytes(F.col("content"), F.lit(offset) - F.col("base"), F.lit(length)).alias("data"))


def sizes(shards: DataFrame) -> DataFrame:
    """One row: n_shards, total_size."""
    return shards.agg(F.countDistinct("doc_id").alias("n_shards"), F.coalesce(F.sum(F.octet_length("content").cast("long") + 1), F.lit(0).cast("long")).alias("total_size"))


def regex(shards: DataFrame, pattern: str, mode: str = "reference", local: bool = False) -> DataFrame:
    """(doc_id, off, len): all matches, by global offset, or with ``local`` by the shards' own."""
    found = matcher.search(shards, pattern, mode)
    return found if local else found.join(bases(shards), "doc_id").select("doc_id", (F.col("off") + F.col("base")).alias("off"), "len")


def keyed_search(kv: DataFrame, pattern: str | bytes, local_keys: bool = False) -> DataFrame:
    """(key): global keys of the records where an occurrence starts, a pattern with newlines may go on in
    the next ones; with ``local_keys`` the set of the shards' own keys, in which equal ones merge."""
    hit = keyed.hits(kv, pattern)
    return hit.select("key").distinct() if local_keys else hit.select(pack(F.col("shard_id"), F.col("key")).alias("key"))


def keyed_count(kv: DataFrame, pattern: str | bytes) -> DataFrame:
    """(shard_id, n): records found, by shard; shards without any too."""
    found = keyed.hits(kv, pattern).groupBy("shard_id").agg(F.count("*").alias("n"))
    return kv.groupBy("shard_id").agg(F.lit(0).cast("long").alias("n")).union(found).groupBy("shard_id").agg(F.sum("n").alias("n"))


def keyed_regex(kv: DataFrame, pattern: str, mode: str = "reference") -> DataFrame:
    """(shard_id, off, len): all matches, by offset in the shard's text."""
    return keyed.regex_search(kv, pattern, mode)


def keyed_regex_keys(kv: DataFrame, pattern: str, mode: str = "reference") -> DataFrame:
    """(key): global keys of the records where a match starts, each once."""
    return keyed.regex_keys(kv, pattern, mode).select(pack(F.col("shard_id"), F.col("key")).alias("key"))


def keyed_get(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) by global keys. The key tells the shard, so only shards that are asked for are read."""
    routed = keys.select("key", shard_of(F.col("key")).alias("shard_id"), local_of(F.col("key")).alias("local"))
    values = kv.where("is_valid").select("shard_id", F.col("key").alias("local"), "value")
    return routed.join(values, ["shard_id", "local"], "left").select("key", F.coalesce("value", F.lit(b"")).alias("value"))


def keyed_access(kv: DataFrame, keys: DataFrame, offset: int, length: int) -> DataFrame:
    if offset < 0:
        raise ValueError("offset must not be negative")
    return keyed_get(kv, keys).select("key", slice_bytes(F.col("value"), offset, length).alias("data"))


def num_keys(kv: DataFrame) -> DataFrame:
    """(shard_id, n)."""
    return kv.groupBy("shard_id").agg(F.count("*").alias("n"))


def num_keys_of(kv: DataFrame, shard: int) -> DataFrame:
    """One row, n: 0 for a shard that isn't there."""
    return keyed.num_keys(kv.where(F.col("shard_id") == shard))
