"""All-match regular expression search, see ``plans.regex`` for the dialect.

The pattern is parsed on the driver. Bytes that every match needs become a filter
that runs before the matcher. A choice of literals stays in generated code; all else
runs over Arrow batches, each text on its own, in one pass per possible start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.bytes import count_overlapping, holds, offsets
from tessella.plans import regex as syntax
from tessella.plans.regex import Automaton, literals, parts, required


def _finder(tree, mode: str, most: int | None):
    auto = Automaton(tree, mode)
    if not auto.first_bytes:
        return lambda data: []
    starts = re.compile(b"[" + b"".join(re.escape(bytes((b,))) for b in sorted(auto.first_bytes)) + b"]", re.S)
    return lambda data: [(m.start(), n) for m in starts.finditer(data) for n in auto.lengths(data, m.start(), most)]


def _over_gaps(found: list[list[tuple[int, int]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Offsets and lengths of a match and any later match of the next sub-expression, and so on: distinct,
    by start. A start's least end allows all that its other ends allow, so it is all that is kept of it."""
    starts = np.array(sorted({o for o, _ in found[0]}), np.int64)
    least = dict.fromkeys(starts.tolist(), 1 << 62)
    for o, n in found[0]:
        least[o] = min(least[o], o + n)
    ends = np.array([least[o] for o in starts.tolist()], np.int64)
    for k, right in enumerate(found[1:], 1):
        right = sorted(right)
        at, to = np.array([o for o, _ in right], np.int64), np.array([o + n for o, n in right], np.int64)
        if k < len(found) - 1:
            i = np.searchsorted(at, ends)
            starts, i = starts[i < len(at)], i[i < len(at)]
            ends = np.minimum.accumulate(to[::-1])[::-1][i]
            continue
        # distinct ends, those that begin last first: what may follow an end is a prefix
        last = dict(zip(to.tolist(), at.tolist()))
        order = sorted(last, key=lambda e: -last[e])
        far, begins = np.array(order, np.int64), -np.array([last[e] for e in order], np.int64)
        for o, m in zip(starts.tolist(), np.searchsorted(begins, -ends, "right").tolist()):
            if m:
                yield np.full(m, o), far[:m] - o


def _choices(words: list[bytes], most: int | None) -> Column:
    """Offsets and lengths of all occurrences of some literals, in generated code."""
    at = lambda w: F.transform(F.flatten(F.coalesce(offsets(F.col("content"), w), F.array().cast("array<array<bigint>>"))), lambda o: F.struct(o.alias("off"), F.lit(len(w)).cast("long").alias("len")))
    return F.concat(*(at(w) for w in words if most is None or len(w) <= most), F.array().cast("array<struct<off:bigint,len:bigint>>"))


def _scanned(docs: DataFrame, trees: list, mode: str) -> DataFrame:
    """The texts that can have matches of all sub-expressions."""
    if mode not in syntax.MODES:
        raise ValueError(f"mode must be one of {syntax.MODES}")
    rows = docs.select("doc_id", F.col("content").cast("binary").alias("content")).where("content is not null")
    for need in {required(t) for t in trees} - {b""}:
        rows = rows.where(holds(F.col("content"), need))
    return rows


def search(docs: DataFrame, pattern: str, mode: str = "reference", max_len: int | None = None) -> DataFrame:
    """(doc_id, off, len): all matches, distinct, of ``docs(doc_id, content)``. Null contents have
    none. ``max_len`` bounds the length of a sub-expression's match; None: no bound."""
    trees = parts(pattern)
    rows = _scanned(docs, trees, mode)
    if len(trees) == 1 and (words := literals(trees[0])) is not None:
        some = reduce(or_, (holds(F.col("content"), w) for w in words), F.lit(False))
        return rows.where(some).select("doc_id", F.explode(_choices(words, max_len)).alias("m")).select("doc_id", "m.off", "m.len")
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [_finder(t, mode, max_len) for t in trees]
        for b in batches:
            rows, offs, lens, size = [], [], [], 0
            for i, content in enumerate(b.column(1)):
                found = []
                for f in finders:
                    found.append(f(content.as_py()))
                    if not found[-1]:
                        break
                if not found[-1]:
                    continue
                for o, n in _over_gaps(found) if len(found) > 1 else (tuple(np.array(found[0], np.int64).T),):
                    rows.append(np.full(len(o), i)), offs.append(o), lens.append(n)
                    size += len(o)
                    if size >= 1 << 16:
                        yield _batch(b, rows, offs, lens)
                        rows, offs, lens, size = [], [], [], 0
            if rows:
                yield _batch(b, rows, offs, lens)

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, off long, len long")


def stream(lines: DataFrame, pattern: str, mode: str = "reference") -> DataFrame:
    """(shard_id, key, off, len): all matches of a pattern without gaps in the texts of shards, given as
    ``lines(shard_id, key, value_offset, value)``. A shard's records pass one after the other, and only
    the starts that a match may still grow from are held, by state."""
    (tree,) = parts(pattern)
    if mode not in syntax.MODES:
        raise ValueError(f"mode must be one of {syntax.MODES}")
    rows = lines.select("shard_id", "key", "value_offset", F.col("value").cast("binary").alias("value")).where("value is not null")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("shard_id", "key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(tree, mode)
        jump = re.compile(b"[" + b"".join(re.escape(bytes((b,))) for b in sorted(auto.first_bytes)) + b"]", re.S) if auto.first_bytes else None
        live: dict[frozenset[int], list[tuple]] = {}
        out: list[list] = [[], [], [], []]
        shard = before = None
        for b in batches if jump else ():
            for s, key, base, value in zip(*(c.to_pylist() for c in b.columns)):
                if before is None or s != shard:
                    live, data, owner = {}, value, key
                else:  # the newline is the record's before
                    base, data, owner = base - 1, b"\n" + value, before
                i = 0
                while i < len(data):
                    if not live:
                        m = jump.search(data, i)
                        if not m:
                            break
                        i = m.start()
                    grown: dict[frozenset[int], list[tuple]] = {}
                    for state, starts in live.items():
                        if nxt := auto.step(state, data[i]):
                            grown[nxt] = grown[nxt] + starts if nxt in grown else starts
                    if data[i] in auto.first_bytes:
                        nxt = auto.step(auto.start, data[i])
                        grown.setdefault(nxt, []).append((owner if i == 0 else key, base + i))
                    live, i = grown, i + 1
                    for state, starts in live.items():
                        if auto.end in state:
                            for k, o in starts:
                                for column, x in zip(out, (s, k, o, base + i - o)):
                                    column.append(x)
                                if len(out[0]) >= 1 << 16:
                                    yield _columns(b, out)
                                    out = [[], [], [], []]
                shard, before = s, key
            if out[0]:
                yield _columns(b, out)
                out = [[], [], [], []]

    return rows.repartition("shard_id").sortWithinPartitions("shard_id", "key").mapInArrow(run, f"shard_id {kinds[0]}, key {kinds[1]}, off long, len long")


def _columns(b: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], b.column(1).type), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["shard_id", "key", "off", "len"])


def _batch(b: pa.RecordBatch, rows: list, offs: list, lens: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(offs)), pa.array(np.concatenate(lens))], names=["doc_id", "off", "len"])


def count(docs: DataFrame, pattern: str, mode: str = "reference") -> DataFrame:
    """(sub_id, n): matches of each sub-expression between gaps, over all texts, in one pass."""
    trees = parts(pattern)
    rows = _scanned(docs, trees if len(trees) == 1 else [], mode)
    choices = [literals(t) for t in trees]
    if all(c is not None for c in choices):
        sizes = [F.coalesce(F.sum(reduce(add, (count_overlapping(F.col("content"), w) for w in c), F.lit(0).cast("long"))), F.lit(0).cast("long")) for c in choices]
        one = rows.agg(F.array(*(F.struct(F.lit(i).alias("sub_id"), n.alias("n")) for i, n in enumerate(sizes))).alias("c"))
        return one.select(F.inline("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [_finder(t, mode, None) for t in trees]
        for b in batches:
            n = [0] * len(trees)
            for content in b.column(0):
                for i, f in enumerate(finders):
                    n[i] += len(f(content.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["sub_id", "n"])

    every = docs.sparkSession.range(len(trees)).select(F.col("id").cast("int").alias("sub_id"), F.lit(0).cast("long").alias("n"))
    return rows.select("content").mapInArrow(run, "sub_id int, n long").union(every).groupBy("sub_id").agg(F.sum("n").alias("n"))


def show(docs: DataFrame, pattern: str, limit: int = 10, mode: str = "reference") -> DataFrame:
    """The first matches in order; ``limit`` 0: all."""
    found = search(docs, pattern, mode).orderBy("doc_id", "off", "len")
    return found.limit(limit) if limit else found


explain = syntax.explain
