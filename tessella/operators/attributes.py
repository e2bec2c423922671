"""Attribute records: (key, attrs ARRAY<STRUCT<pos, k, v>>), see ``sources.corpus.parse_attributes``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.corpus import records


def _has(name: str, value: str) -> Column:
    return F.exists("attrs", lambda a: (a["k"] == name) & (a["v"] == value))


def _text(separator: str) -> Column:
    return F.array_join(F.transform("attrs", lambda a: F.concat(a["k"], F.lit("="), a["v"])), separator)


def search(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(key): records with an attribute of that name and exactly that value."""
    return rows.where(_has(name, value)).select("key")


def count(rows: DataFrame, name: str, value: str) -> DataFrame:
    """One row, n: records that ``search`` finds."""
    return search(rows, name, value).agg(F.count("*").alias("n"))


def get(rows: DataFrame, keys: DataFrame | None = None, separator: str = ",") -> DataFrame:
    """(key, record): the record as text, pairs in their order; empty for absent keys."""
    shown = rows.select("key", _text(separator).alias("record"))
    return shown if keys is None else keys.join(shown, "key", "left").select("key", F.coalesce("record", F.lit("")).alias("record"))


def get_attribute(rows: DataFrame, name: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, value): the first attribute of that name; null where there is none."""
    value = F.get(F.filter("attrs", lambda a: a["k"] == name), F.lit(0))["v"]
    shown = rows.select("key", value.alias("value"))
    return shown if keys is None else keys.join(shown, "key", "left").select("key", "value")


def rendered(rows: DataFrame, separator: str = ",") -> DataFrame:
    """The records as keyed lines of their text, for all verbs of ``keyed`` and ``sharded``: by
    ``shard_id`` where there is one, else one shard."""
    return records(rows, "key", _text(separator), F.col("shard_id") if "shard_id" in rows.columns else None)
