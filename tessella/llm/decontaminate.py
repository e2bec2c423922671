"""Benchmark decontamination by a broadcast set of normalised n-gram windows.

A text is lower-cased (A-Z only) and cut into words; every ``n`` consecutive
words of a benchmark item are a window, an item with fewer words is one window
of its own length.  The windows' hashes are a sorted set that every worker holds;
the documents' token windows are hashed a batch at a time, and each hit is verified
byte by byte before it counts.  Hits can be reported, cut out as spans, or drop
the document.

A worker holds the items' normalised text once, and numbers: nothing per window but
its hash, its place and its items.  What that takes is worked out from the items'
counted words before anything is broadcast; beyond ``block_bytes`` the items are
dealt into blocks, and the documents pass one block after the other.  No block is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import Scratch, named, numbered, table

WINDOW = 10
#: Bytes that one broadcast may hold; bytes per word of an item beside its text (hash, place, items).
BLOCK_BYTES, WORD_BYTES = 64 << 20, 28
#: Text that a worker normalises at once; words that it hashes at once.
CHUNK_BYTES, PIECE = 1 << 20, 1 << 17
#: Of a longer word (unspaced text) the digest stands in the hashed text.
LONGEST = 4096

_TO_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text. All bytes of a non-ASCII character are word bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORD).split() if text else []


class _Powers:
    """Powers of the hash's base and of its inverse, as many as the longest chunk so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class _Stream:
    """The words of several texts one after the other, and hashes of runs of words by differences of one running sum."""

    def __init__(self, texts: list[list[bytes]]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths)
        flat = list(chain.from_iterable(texts))
        if max(map(len, flat), default=0) > LONGEST:
            flat = [w if len(w) <= LONGEST else b"\x01" + sha256(w).hexdigest().encode() for w in flat]
        self.data = b" ".join(flat)
        raw = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        n = int(self.lengths.sum())
        self.start = np.concatenate([[0], gaps + 1]) if n else np.zeros(0, np.int64)
        self.stop = np.concatenate([gaps, [len(raw)]]) if n else np.zeros(0, np.int64)
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[raw] * up[: len(raw)])])

    def runs(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words that lie in one text."""
        at = np.arange(max(0, len(self.start) - size + 1))
        return at[at + size <= np.repeat(self.ends, self.lengths)[: len(at)]]

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        a, b = self.start[at], self.stop[at + size - 1]
        h = (self.sums[b] - self.sums[a]) * self.down[a]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def text(self, at: int, size: int) -> bytes:
        return self.data[self.start[at] : self.stop[at + size - 1]]


class Windows:
    """The windows of benchmark items, looked up by hash and verified by their bytes."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        cut = [(i, w) for i, t in items if (w := words(t))]
        self.names = sorted({i for i, _ in cut if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        self.by_length: dict[int, tuple] = {}
        for size in sorted({min(n, len(w)) for _, w in cut}):
            some = [(i, w) for i, w in cut if min(n, len(w)) == size]
            stream = _Stream([w for _, w in some])
            at = stream.runs(size)
            owner = np.array([-1 if i is None else number[i] for i, _ in some], np.int32)[np.searchsorted(stream.ends, at, "right")]
            h = stream.hashes(at, size)
            order = np.lexsort((owner, h))
            h, at, owner = h[order], at[order], owner[order]
            # rows of one hash: a group for each distinct text
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            group, texts = np.zeros(len(h), np.int64), []
            for a, b in zip(first, [*first[1:], len(h)]):
                seen: dict[bytes, int] = {}
                for k in range(a, b):
                    t = stream.text(at[k], size)
                    if t not in seen:
                        seen[t] = len(texts)
                        texts.append((h[a], at[k]))
                    group[k] = seen[t]
            order = np.lexsort((owner, group))
            bounds = np.searchsorted(group[order], np.arange(len(texts) + 1))
            places = np.array([p for _, p in texts], np.int64)
            self.by_length[size] = (
                np.array([x for x, _ in texts], np.uint64), stream.start[places].astype(np.int32), stream.stop[places + size - 1].astype(np.int32), bounds.astype(np.int32), owner[order], stream.data,
            )

    def scan(self, docs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, set[str]]]:
        """Of each document: hit marks per word, and the items found."""
        widest = max(self.by_length, default=1)
        marks = [np.zeros(len(d) + 1, np.int32) for d in docs]
        found: dict[int, set[int]] = {}
        pieces, size = [], 0
        for d, w in enumerate(docs):
            for a in range(0, len(w), PIECE):
                pieces.append((d, a, w[a : a + PIECE + widest - 1]))
                size += len(pieces[-1][2])
                if size >= PIECE:
                    self._scan(pieces, marks, found)
                    pieces, size = [], 0
        if pieces:
            self._scan(pieces, marks, found)
        for d, m in enumerate(marks):
            yield np.cumsum(m[:-1]) > 0, {self.names[i] for i in found.get(d, ()) if i >= 0}

    def _scan(self, pieces: list[tuple[int, int, list[bytes]]], marks: list[np.ndarray], found: dict[int, set[int]]) -> None:
        stream = _Stream([w for *_, w in pieces])
        for size, (hashes, start, stop, bounds, owner, data) in self.by_length.items():
            at = stream.runs(size)
            h = stream.hashes(at, size)
            maybe = np.zeros(1 << 18, bool)  # the first bits of the windows' hashes
            maybe[hashes >> np.uint64(46)] = True
            some = maybe[h >> np.uint64(46)]
            at, h = at[some], h[some]
            low = np.searchsorted(hashes, h)
            hit = hashes[np.minimum(low, len(hashes) - 1)] == h
            for p, k in zip(at[hit].tolist(), low[hit].tolist()):
                ours = stream.text(p, size)
                while k < len(hashes) and data[start[k] : stop[k]] != ours:  # texts of one hash stand side by side
                    k = k + 1 if k + 1 < len(hashes) and hashes[k + 1] == hashes[k] else len(hashes)
                if k < len(hashes):
                    i = int(np.searchsorted(stream.ends, p, "right"))
                    d, first, _ = pieces[i]
                    place = first + p - int(stream.ends[i] - stream.lengths[i])
                    marks[d][place] += 1
                    marks[d][place + size] -= 1
                    found.setdefault(d, set()).update(owner[bounds[k] : bounds[k + 1]].tolist())


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def _cut(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and what stands between them; one space joins what is left."""
    data = text.encode("utf-8", "surrogatepass")
    shape = np.frombuffer(data.translate(_TO_WORD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], shape.astype(np.int8), [0]]))).reshape(-1, 2)
    kept, at = [], 0
    for s in spans:
        kept.append(data[at : edge[s["start"]][0]].rstrip())
        at = edge[s["end"] - 1][1]
    kept.append(data[at:].lstrip() if at else data)
    return b" ".join(k for k in kept if k).decode("utf-8", "surrogatepass")


_FOUND = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.string())}
_FOUND_SQL = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _pass(docs: DataFrame, windows, text: str, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, spans and items, which add to those of an earlier block; or, with
    ``cut``, without them and without the spans' words. One function, so one Python worker a task."""
    names = [c for c in docs.columns if c not in _FOUND]
    earlier = len(names) < len(docs.columns)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for b in batches:
            column = b.column(at)
            start = 0
            while start < len(column):
                size, stop, texts, part = 0, start, [], []
                while stop < len(column) and (size < CHUNK_BYTES or stop == start):
                    texts.append(column[stop].as_py())
                    part.append(words(texts[-1]))
                    size += len(texts[-1] or "")
                    stop += 1
                rows = b.slice(start, stop - start)
                old = [rows.column(len(names) + k).to_pylist() for k in (1, 2)] if earlier else None
                n, spans, items = [], [], []
                for i, (hit, found) in enumerate(w.scan(part)):
                    if old:
                        hit = hit.copy()
                        for s in old[0][i]:
                            hit[s["start"] : s["end"]] = True
                        found = found.union(old[1][i])
                    n.append(len(part[i]))
                    spans.append(_spans(hit))
                    items.append(sorted(found))
                kept = [rows.column(k) for k in range(len(names))]
                if cut:
                    if any(spans):
                        kept[at] = pa.array([_cut(t, s) if s else t for t, s in zip(texts, spans)], kept[at].type)
                    yield pa.RecordBatch.from_arrays(kept, names=names)
                else:
                    made = [pa.array(x, kind) for x, kind in zip((n, spans, items), _FOUND.values())]
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *_FOUND])
                start = stop

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, *(_FOUND if earlier else ())).mapInArrow(run, kept if cut else f"{kept}, {_FOUND_SQL}")


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, text: str, item_id: str, item_text: str, block_bytes: int, cut: bool) -> DataFrame:
    """Numbered columns of ``docs`` after all blocks."""
    spark = docs.sparkSession
    at = f"c{docs.columns.index(text)}"
    docs = numbered(docs)
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).distinct()
    n_words = F.size(F.split("t", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = bench.agg(F.sum(F.octet_length("t") + n_words.cast("long") * WORD_BYTES)).first()[0] or 0
    blocks = max(1, -(-total * 4 // (block_bytes * 3)))  # dealt by a hash, some get more
    scratch, last = Scratch(spark), None
    for k in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        rows = [(r["i"], r["t"]) for r in part.toLocalIterator()]  # a block, as summed above
        docs = _pass(docs, spark.sparkContext.broadcast(Windows(rows, n)), at, cut and k == blocks - 1)
        if k < blocks - 1:
            docs = scratch.cut(docs)
            scratch.drop(last)
            last = docs
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with what their words share with benchmark windows.

    Adds n_words, spans (word positions [start, end) inside an occurrence of a
    window, merged) and items (ids as strings, sorted, distinct) and replaces
    columns of those names.  A null or empty text has no words and no hits, an
    item without words has no windows, and an item with a null id marks words but
    isn't listed.  Items that repeat an id are one item.
    """
    return named(_scanned(docs, benchmark, n, text, item_id, item_text, block_bytes, False), docs.columns, *_FOUND)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", n: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the benchmark's passages: ``spans`` cuts them out of the texts
    and keeps every document, ``documents`` drops the documents that have any.
    Rows without hits stay byte for byte as they are. Columns stay as they are, whatever their names."""
    if mode not in ("spans", "documents"):
        raise ValueError(f"mode must be spans or documents, not {mode!r}")
    found = _scanned(docs, benchmark, n, text, item_id, item_text, block_bytes, mode == "spans")
    return named(found if mode == "spans" else found.where(F.size("spans") == 0), docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(g) AS k FROM bw),
dw AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, sizes WHERE len(w) >= k)
), hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (g)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES = {"op2_decontaminate": ORACLE}
