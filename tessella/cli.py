"""Command line: save a corpus, or query one.

    python -m tessella.cli save file|kv|attrs INPUT OUTPUT
    python -m tessella.cli shell file|kv|attrs INPUT      (commands on standard input)

Commands: search Q, count Q, extract OFFSET LENGTH, get KEY [ATTRIBUTE], regex R,
explain R, exit; with attrs: search NAME VALUE, count NAME VALUE.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import attributes, flat, keyed, regex
from tessella.sources import corpus, storage

#: Matches of a regular expression that are shown.
SHOWN = 10


def open_corpus(spark: SparkSession, kind: str, path: str) -> DataFrame:
    docs = corpus.read_files(spark, path).select("doc_id", "content")
    return {"file": lambda: docs, "kv": lambda: corpus.lines(docs), "attrs": lambda: corpus.attribute_lines(docs)}[kind]()


def answer(spark: SparkSession, kind: str, data: DataFrame, line: str):
    """The rows of a command, or a text."""
    name, *rest = line.split(" ", 1)
    arg = rest[0] if rest else ""
    keys = lambda k: spark.createDataFrame([(int(k),)], "key long")
    if name == "explain":
        return regex.explain(arg)
    if name == "regex":
        if kind == "file":
            return regex.show(data, arg)
        return keyed.regex_search(data if kind == "kv" else attributes.rendered(data), arg).orderBy("shard_id", "off", "len").limit(SHOWN)
    if kind == "attrs":
        if name in ("search", "count"):
            return (attributes.search if name == "search" else attributes.count)(data, *arg.split(" ", 1))
        key, *attribute = arg.split(" ", 1)
        return attributes.get_attribute(data, attribute[0], keys(key)) if attribute else attributes.get(data, keys(key))
    if name in ("search", "count"):
        view = flat if kind == "file" else keyed
        return (view.search if name == "search" else view.count)(data, arg)
    if name == "extract" and kind == "file":
        return flat.extract(data, *map(int, arg.split()))
    if name == "get" and kind == "kv":
        return keyed.get(data, keys(arg))
    raise ValueError(f"no such command: {line}")


def main(args: list[str]) -> None:
    action, kind, path = args[:3]
    spark = SparkSession.builder.getOrCreate()
    data = open_corpus(spark, kind, path)
    if action == "save":
        print(storage.save(args[3], **{kind: data}))
        return
    for line in map(str.strip, sys.stdin):
        if line == "exit":
            break
        out = answer(spark, kind, data, line)
        for r in [out] if isinstance(out, str) else map(str, map(tuple, out.toLocalIterator())):  # a part of the rows at a time
            print(r)


if __name__ == "__main__":
    main(sys.argv[1:])
