"""Corpora as DataFrames.

* flat: ``(doc_id, content BINARY)``, one row per file, buffer or document
* keyed lines: ``(shard_id, key, value_offset, value BINARY, is_valid)``
* attribute records: ``(key, attrs ARRAY<STRUCT<pos, k, v>>)``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.bytes import view

#: The virtual byte after a text's end: it counts in sizes and is read past the end, but is never stored.
SENTINEL = b"\x01"
#: Keys of one block of running offsets, a power of two.
KEYS = 1 << 16


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``; its id is a hash of its path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def from_buffers(spark: SparkSession, buffers: list[bytes]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(bytearray, buffers))), "doc_id long, content binary")


def from_table(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("content"))


def lines(shards: DataFrame, shard: str = "doc_id") -> DataFrame:
    """Keyed lines of each row's content: key is the line's number, value_offset its first
    byte. A final newline is followed by one more, empty record, and empty content is
    one empty record; null content has none. A value doesn't hold its newline."""
    pieces = shards.where("content is not null").select(F.col(shard).alias("shard_id"), F.posexplode(F.split(view(F.col("content")), "\n", -1)).alias("key", "v"))
    start = F.coalesce(F.sum(F.length("v").cast("long") + 1).over(Window.partitionBy("shard_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return pieces.select("shard_id", F.col("key").cast("long").alias("key"), start.alias("value_offset"), F.encode("v", "ISO-8859-1").alias("value"), F.lit(True).alias("is_valid"))


def records(df: DataFrame, key: str, value: str | Column, shard: Column | None = None) -> DataFrame:
    """Keyed lines from a table: offsets as if each shard's values stood in key order, a newline after each.

    Sizes are summed in blocks of ``KEYS`` keys. A block starts with the sum of those before it,
    so that no task sorts a shard; only the blocks' sums meet by shard."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select((shard if shard is not None else F.lit(0)).cast("long").alias("shard_id"), F.col(key).cast("long").alias("key"), F.coalesce(value.cast("binary"), F.lit(b"")).alias("value"))
    rows = rows.select("*", (F.octet_length("value").cast("long") + 1).alias("size"), F.shiftright("key", KEYS.bit_length() - 1).alias("block"), F.lit(True).alias("is_valid"))
    before = Window.partitionBy("shard_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("shard_id", "block").agg(F.sum("size").alias("size"))
    marks = sums.select("shard_id", F.lit(None).cast("long"), F.lit(None).cast("binary"), F.sum("size").over(before), "block", F.lit(False))
    start = F.sum("size").over(Window.partitionBy("shard_id", "block").orderBy("is_valid", "key").rowsBetween(Window.unboundedPreceding, -1))
    return rows.union(marks).select("shard_id", "key", F.coalesce(start, F.lit(0).cast("long")).alias("value_offset"), "value", "is_valid").where("is_valid")


def parse_attributes(line: Column, separator: str = ",") -> Column:
    """``k=v,k=v`` as an array in order: a pair is cut at its first ``=``, keys may repeat,
    and a pair without ``=`` raises when the row is read. An empty line has no pairs."""
    pair = lambda p, i: F.when(F.contains(p, F.lit("=")), F.struct(i.alias("pos"), F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1, F.length(p)).alias("v"))).otherwise(F.raise_error(F.concat(F.lit("not an attribute pair: "), p)))
    return F.when(line == "", F.array().cast("array<struct<pos:int,k:string,v:string>>")).otherwise(F.transform(F.split(line, f"\\Q{separator}\\E", -1), pair))


def attribute_lines(shards: DataFrame, separator: str = ",", max_keys: int | None = None) -> DataFrame:
    """Attribute records of each row's content; a final newline adds no record here."""
    text = F.regexp_replace(F.col("content").cast("string"), "\n\\z", "")
    rows = shards.where("octet_length(content) > 0").select(F.col("doc_id").alias("shard_id"), F.posexplode(F.split(text, "\n", -1)).alias("key", "line"))
    out = rows.select("shard_id", F.col("key").cast("long").alias("key"), parse_attributes(F.col("line"), separator).alias("attrs"))
    if max_keys is not None and out.select(F.explode("attrs.k").alias("k")).distinct().limit(max_keys + 1).count() > max_keys:
        raise ValueError(f"more than {max_keys} attributes")
    return out
