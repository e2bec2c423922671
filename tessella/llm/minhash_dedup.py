"""MinHash near-duplicate groups by fast similarity sketching.

A document is the set of its distinct ``n``-word shingles.  Its sketch is filled
in rounds of hashed bin placement (Dahlgaard, Knudsen, Thorup 2017): in round
``i < t`` each shingle falls into bin ``h_i(shingle) mod t`` with value
``i + h'_i(shingle)``, in round ``t + b`` every shingle falls into bin ``b``, and a
bin keeps its least value.  After ``2t`` rounds no bin is empty, whatever the
set's size, and the share of agreeing bins is concentrated about the Jaccard
similarity as for ``t`` independent hash functions.

Bins are cut into bands; equal bands make candidates, and each link is confirmed
on the full shingle sets, with integers.  Groups are the connected components of
the confirmed links.  With 32 bands of 5 rows a pair at similarity 0.85 shares
none with probability (1 - 0.85^5)^32, under 1e-8, and at 0.8 under 4e-6.

No bucket is ever expanded into all its pairs:

1. Texts with equal words, by a 128-bit digest of all of them, are one class; only its
   representative goes on.
2. In each bucket all members are compared with its smallest member only. The
   confirmed links give first components.
3. In a bucket that then holds more than one component, the members outside its
   largest one are compared with all members of other components, in blocks of
   bounded size that are dealt to tasks. Blocks hold the sets as sorted hashes; what
   they find is confirmed on the full sets like the links before.

Nothing is sampled or capped, and only sketches, ids and the texts of candidates
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import Scratch, connected_components, named, numbered, table

SHINGLE = 5
THRESHOLD = 80
BANDS, ROWS = 32, 5
#: Documents of a block in step 3, and shingles about.
OUTSIDE, INSIDE, BLOCK_SHINGLES = 128, 256, 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    """Distinct ``n``-word shingles; the whole sequence if there are fewer words; empty without words."""
    w = split(text)
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else {tuple(w)} if w else set()


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(w: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    from xxhash import xxh64_intdigest

    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
    size = min(n, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return np.unique(out)


class Sketch:
    """Fast similarity sketches of ``t`` bins."""

    def __init__(self, t: int, seed: int = 1):
        self.t = t
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(1, 2**63, 2 * t, dtype=np.uint64)

    def __call__(self, items: np.ndarray) -> np.ndarray:
        """Bins as 64-bit integers: the round in the upper bits, the hash within it below."""
        t, n = self.t, len(items)
        bins = np.full(t, np.uint64(2**64 - 1))
        step = max(1, 4096 // n)
        for first in range(0, 2 * t, step):
            rounds = np.arange(first, min(2 * t, first + step))
            h = _mix(items[None, :] ^ self.seeds[rounds, None])
            low = (h & np.uint64(2**32 - 1)).astype(np.int64)
            place = np.where(rounds[:, None] < t, (low * t) >> 32, rounds[:, None] - t)
            value = (rounds[:, None].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
            flat = place.ravel()
            np.minimum.at(bins, flat, value.ravel())
            if (bins >> np.uint64(32)).max() < first + step:  # later rounds have larger values
                break
        return bins


def _bands(bins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + bins[j::rows][:bands])
    return out.view(np.int64)


def _sketched(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest of the words, bands) of each row; rows without words have no digest and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_hexdigest

        sketch = Sketch(bands * rows)
        for b in batches:
            sizes, sets, keys = [], [], []
            for x in b.column(1):
                w = split(x.as_py())
                h = shingle_hashes(w, n)
                sizes.append(len(h))
                sets.append(xxh3_128_hexdigest(b" ".join(w)) if w else None)
                keys.append(_bands(sketch(h), bands, rows) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "s", "bands"])

    return docs.mapInArrow(run, "id long, n long, s string, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ours = None, set()
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                ta = ta.as_py()
                if ta != last:
                    last, ours = ta, shingles(ta, n)
                other = shingles(tb.as_py(), n)
                both = len(ours & other)
                keep.append(both > 0 and 100 * both >= threshold * (len(ours) + len(other) - both))
            rows = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"])

    a = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _hashed(texts: DataFrame, n: int) -> DataFrame:
    """(id, h): the shingles' sorted hashes, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_hashes(split(t.as_py()), n).tobytes() for t in part.column(1)], pa.binary())], names=["id", "h"])

    return texts.select("id", "t").mapInArrow(run, "id long, h binary")


def _block_links(group, threshold: int):
    """Candidates between the outside and the inside documents of one block pair: for each
    outside document one into each other component, which connects as all would."""
    import pandas as pd

    rows = [np.frombuffer(h, np.uint64) for h in group["h"]]
    size = np.array([len(r) for r in rows])
    inside = np.flatnonzero(group["inside"].to_numpy())
    outside = np.flatnonzero(group["outside"].to_numpy())
    comp, key = group["comp"].to_numpy(), group["id"].to_numpy()
    # postings of the inside documents by shingle
    who = np.repeat(np.arange(len(inside)), size[inside])
    what = np.concatenate([rows[i] for i in inside]) if len(inside) else np.zeros(0, np.uint64)
    order = np.argsort(what, kind="stable")
    what, who = what[order], who[order]
    out = []
    for o in outside:
        first, last = np.searchsorted(what, rows[o], "left"), np.searchsorted(what, rows[o], "right")
        many = last - first
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(who[at], minlength=len(inside))
        ok = (both > 0) & (100 * both >= threshold * (size[o] + size[inside] - both)) & (comp[inside] != comp[o])
        hit = inside[ok]
        _, one = np.unique(comp[hit], return_index=True)
        out += [(key[o], key[i]) for i in hit[one]]
    return pd.DataFrame(out, columns=["a", "b"])


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: int = THRESHOLD, text: str = "text", key: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of ``docs``.

    Rows are linked when ``100 * |A & B| >= threshold * |A | B|`` for their shingle
    sets; component_id is the smallest key that links lead to, itself included, and
    kept says that it is the row's own.  A null, empty or blank text has no
    shingles and is linked with nothing.  Rows that share a key are one document: a
    link of one holds for all.  Rows with a null key are linked with nothing, have
    no component_id, and are kept.  ``key`` is an integer column.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    all_rows = scratch.cut(_sketched(source, n, bands, rows))
    sets = all_rows.where("s is not null and id is not null")
    # of classes of one row there is nothing to look up; a hot class's rows can be split where they meet its one row
    reps = scratch.cut(sets.groupBy("s").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m"))
    of = sets.join(reps, "s", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), "bands")
    classes = scratch.cut(of.withColumn("bands", F.when(F.col("id") == F.col("rep"), F.col("bands"))))
    heads = classes.where("bands is not null").select("id", "n", F.posexplode("bands").alias("band", "h")).select("id", "n", F.xxhash64("band", "h").alias("bucket"))
    # a table of its own: AQE can split a hot bucket's members where they meet their one lead
    first = scratch.cut(heads.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1").drop("m"))
    members = scratch.cut(heads.join(first, "bucket").select("bucket", "id", "n", "lead"))
    scratch.drop(first)
    fits = F.col("n") * 100 >= F.col("lead.n") * threshold
    fits &= F.col("lead.n") * 100 >= F.col("n") * threshold
    pairs = members.where((F.col("id") != F.col("lead.id")) & fits).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    # tables of their own, else the distinct and the semi-join would fix the partitioning of a hot lead's pairs
    pairs = scratch.cut(pairs)
    texts = scratch.cut(source.join(members.select("id").distinct(), "id", "left_semi"))
    links = scratch.cut(_confirmed(pairs, texts, n, threshold))
    scratch.drop(pairs)

    comps = scratch.cut(connected_components(links, scratch))
    scratch.drop(links)
    labelled = members.select("bucket", "id", "n").join(comps, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("comp"))
    sizes = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    top = F.max(F.struct("m", "w", F.col("comp").alias("main"))).alias("top")
    mixed = sizes.groupBy("bucket").agg(top, F.sum("m").alias("inside"), F.sum("w").alias("words"), F.count("*").alias("k")).where("k > 1 and inside > 2")
    deal = lambda m, w, most: F.ceil(F.greatest(m / most, w / BLOCK_SHINGLES)).alias("k")
    mixed = scratch.cut(mixed.select("bucket", F.col("top.main").alias("main"), deal(F.col("inside"), F.col("words"), INSIDE).alias("ki"), deal(F.col("inside") - F.col("top.m"), F.col("words") - F.col("top.w"), OUTSIDE).alias("ko")))
    rows_ = labelled.join(mixed, "bucket")
    inner = rows_.withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), "ki")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ko") - 1))).withColumn("role", F.lit(1))
    outer = rows_.where("comp != main").withColumn("o", F.pmod(F.xxhash64("id", F.lit(2)), "ko")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ki") - 1))).withColumn("role", F.lit(2))
    blocks = scratch.cut(inner.select("bucket", "i", "o", "id", "comp", "role").union(outer.select("bucket", "i", "o", "id", "comp", "role")))
    scratch.drop(members)
    hashed = scratch.cut(_hashed(texts.join(blocks.select("id").distinct(), "id", "left_semi"), n))
    dealt = blocks.join(hashed, "id").select("bucket", "i", "o", "id", "comp", "h", (F.col("role") == 1).alias("inside"), (F.col("role") == 2).alias("outside"))
    late = scratch.cut(dealt.groupBy("bucket", "i", "o").applyInPandas(lambda g: _block_links(g, threshold), "a long, b long").distinct())
    late = scratch.cut(_confirmed(late, texts, n, threshold))

    # rows that share a key but not a text tie their classes together
    same = classes.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b != top").select("id", "b")
    same = classes.join(same, "id").select(F.col("rep").alias("a"), "b")
    named = scratch.cut(connected_components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).union(late).union(same), scratch))
    # members of a class follow its representative
    followed = classes.select("id", "n", "rep").join(named.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    alone = all_rows.where("s is null or id is null").select("id", "n", F.lit(None).cast("long").alias("component"))
    # a row without words follows a row of its key that has some
    alone = alone.join(followed.groupBy("id").agg(F.min("component").alias("c")), "id", "left").select("id", "n", F.col("c").alias("component"))
    out = followed.union(alone)
    component = F.coalesce("component", "id")
    return scratch.finish(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **kw) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the rows whose key is
    their group's smallest (of repeated rows with that key, all). Columns may have any name."""
    gone = near_duplicates(docs, text=text, key=key, **kw).where("not kept").select(F.col(key).alias("gone")).distinct()
    rest = numbered(docs).join(gone, F.col(f"c{docs.columns.index(key)}") == F.col("gone"), "left_anti")
    return named(rest, docs.columns)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, threshold=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id
), c AS (SELECT id, min(r) AS r FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.r AS component_id, d.doc_id = c.r AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""

QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}
ORACLES = {"op3_minhash_dedup": ORACLE}
