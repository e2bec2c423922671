"""Embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of at least ``c`` is a Euclidean distance of at most
``eps = sqrt(2 - 2c)``.  Per label, pivots partition the vectors: the nearest
pivot is a vector's home cell.  If x at home in cell i and y at home in cell j are
within eps, the triangle inequality gives ``d(x, p_j) <= d(x, p_i) + 2 eps``, and
the hyperplane between the pivots gives
``d(x, p_j)^2 - d(x, p_i)^2 <= 2 eps d(p_i, p_j)``.  A vector is copied, as a guest,
to exactly those cells that pass both, so each vector meets all its partners in
its own home cell and cells join independently. No partner is lost.

Cells of any size are cut into blocks, and a task joins one block of homes with
one block of the cell's vectors in double precision; it returns link counts and a
spanning forest of its links, never all pairs.  Equal vectors of a label are one
class with a count.  Pivots are vectors chosen by hash.  How many a label gets grows
with it, up to ``max_pivots``: of the powers of two the one that costs least by what
a sample of its vectors shows, since pivots that prune little cost copies.  Labels
and lengths of vectors never meet: both part the vectors before the pivots do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import Scratch, connected_components, table

COSINE = 0.93
#: Vectors that a cell should hold at least, about; pivots of one label at most; vectors that their number is tried on.
CELL, MAX_PIVOTS, PROBES = 256, 4096, 256
#: Components of all sampled vectors at most (128 MB of doubles on the driver and each worker).
ALL_COMPONENTS = 16 << 20
#: What shipping a copy of a vector costs, in products of two vectors.
SHIP = 1000
#: Vectors of a block.
BLOCK = 2048


def _unit(x) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and all cells that it must go to."""
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
    near = d.argmin(1)
    own = d[np.arange(len(x)), near][:, None]
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[near]
    inside = (d <= own + 2 * eps + 1e-9) & (d * d - own * own <= 2 * eps * apart + 1e-9)
    inside[np.arange(len(x)), near] = True
    return near, inside


def _pivots(sample: np.ndarray, n: int, eps: float, cell: int, most: int) -> np.ndarray | None:
    """The pivots of a label of ``n`` vectors, out of a sample of them; None if one cell costs least."""
    probes = sample[: min(PROBES, len(sample) // 4)]
    rest = sample[len(probes) :][: min(most, -(-n // cell))]
    best, k = (n + SHIP, 1), 2
    while len(probes) and k <= len(rest):
        copies = _cells(probes, rest[:k], eps)[1].sum(1).mean()
        best = min(best, (k + n * copies / k + SHIP * copies, k))
        k *= 2
    return rest[: best[1]] if best[1] > 1 else None


def _assign(rows: DataFrame, pivots, eps: float) -> DataFrame:
    """The rows with their home cell and, for guests, each cell that they may have partners in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part = pivots.value
        for b in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            parts: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                parts.setdefault(key, []).append(i)
            v = b.column(4).to_numpy(zero_copy_only=False)
            take, cell, home = [], [], []
            for key, at in parts.items():
                at = np.array(at)
                if key not in by_part:
                    take.append(at), cell.append(np.zeros(len(at), int)), home.append(np.ones(len(at), bool))
                    continue
                near, inside = _cells(_unit(np.stack(v[at])), by_part[key], eps)
                i, j = np.nonzero(inside)
                take.append(at[i]), cell.append(j), home.append(near[i] == j)
            take, cell, home = map(np.concatenate, (take, cell, home))
            for i in range(0, len(take), 4096):
                t = pa.array(take[i : i + 4096])
                yield pa.RecordBatch.from_arrays([*(c.take(t) for c in b.columns), pa.array(cell[i : i + 4096].astype(np.int32)), pa.array(home[i : i + 4096])], names=["label", "d", "id", "m", "v", "cell", "home"])

    return rows.mapInArrow(run, "label long, d int, id long, m long, v array<double>, cell int, home boolean")


def _join_block(g, cosine: float):
    """Link counts of the home vectors of a block pair, and links that connect as all of them would."""
    import pandas as pd

    x = _unit(np.stack(g["v"].to_numpy()))
    ids, m = g["id"].to_numpy(), g["m"].to_numpy()
    homes, others = np.flatnonzero(g["role"].to_numpy() == 1), np.flatnonzero(g["role"].to_numpy() == 2)
    near = x[homes] @ x[others].T >= cosine
    near &= ids[homes][:, None] != ids[others][None, :]
    links = near @ m[others]
    root_o = np.full(len(others), np.iinfo(np.int64).max)
    root_h = ids[homes].copy()
    far = np.iinfo(np.int64).max
    touched = near.any(1)
    h, sub = np.flatnonzero(touched), near[touched]
    while len(h):
        new_o = np.minimum(ids[others], np.where(sub, root_h[h][:, None], far).min(0))
        new_o = np.minimum(new_o, root_o)
        new_h = np.minimum(root_h[h], np.where(sub, new_o[None, :], far).min(1))
        if (new_h == root_h[h]).all() and (new_o == root_o).all():
            break
        root_h[h], root_o = new_h, new_o
    used = near.any(0)
    out = pd.DataFrame({"id": ids[homes], "links": links.astype("int64"), "root": np.where(touched, root_h, ids[homes])})
    more = pd.DataFrame({"id": ids[others][used], "links": 0, "root": root_o[used]})
    return pd.concat([out[(out.links > 0)], more])


def vector_links(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of each row of ``vectors``.

    Two rows are linked when their labels are equal and not null and the cosine of
    their vectors, in double precision, is at least ``cosine`` (above 0). Vectors
    that are null, empty, zero or hold null or non-finite components are linked with
    nothing.  n_links counts the other rows linked directly, repeated rows too;
    component_id is the smallest key that links lead to.  Rows that share a key are
    one node. Rows with a null key have no links, no component_id, and are kept.
    Vectors of unlike lengths are never linked, whatever their labels.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("v"), F.col(label).cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = scratch.cut(rows.withColumn("ok", valid))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    classes = scratch.cut(classes.select("label", F.size("v").alias("d"), "id", "m", "v"))

    eps = math.sqrt(2 - 2 * cosine)
    counts = classes.groupBy("label", "d").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    wanted = F.least(F.ceil(F.col("n") / cell), F.lit(max_pivots)) + PROBES
    chosen = classes.join(counts, ["label", "d"]).where(F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 40)) < wanted / F.col("n") * (1 << 40))
    longest = classes.agg(F.max("d")).first()[0] or 1
    sampled: dict[tuple, list] = {}
    size: dict[tuple, int] = {}
    # at most ALL_COMPONENTS numbers; a label without any of them is one cell
    for r in chosen.select("label", "d", "n", "v").orderBy(F.xxhash64("v", F.lit(8))).limit(max(1, ALL_COMPONENTS // longest)).toLocalIterator():
        sampled.setdefault((r["label"], r["d"]), []).append(r["v"])
        size[r["label"], r["d"]] = r["n"]
    found = {k: _pivots(_unit(v), size[k], eps, cell, max_pivots) for k, v in sampled.items()}
    shared = spark.sparkContext.broadcast({k: p for k, p in found.items() if p is not None})
    placed = scratch.cut(_assign(classes, shared, eps))

    part = ["label", "d", "cell"]
    sizes = placed.groupBy(part).agg(F.sum(F.col("home").cast("long")).alias("h"), F.count("*").alias("a")).where("h > 0")
    blocks = scratch.cut(sizes.select(*part, F.ceil(F.col("h") / block).alias("kh"), F.ceil(F.col("a") / block).alias("ka")))
    dealt = placed.join(blocks, part)
    one = dealt.where("home").withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), "kh")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ka") - 1))).withColumn("role", F.lit(1))
    two = dealt.withColumn("j", F.pmod(F.xxhash64("id", F.lit(2)), "ka")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kh") - 1))).withColumn("role", F.lit(2))
    names = [*part, "i", "j", "role", "id", "m", "v"]
    joined = one.select(names).union(two.select(names)).groupBy(*part, "i", "j").applyInPandas(lambda g: _join_block(g, cosine), "id long, links long, root long")
    links = scratch.cut(joined)
    scratch.drop(placed)

    totals = links.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.join(totals, "id", "left").select("label", "v", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"))
    # tables of their own: the rows of a hot class can be split where they meet them
    per_class = scratch.cut(per_class)
    members = scratch.cut(rows.where("ok").join(per_class, ["label", "v"]).select("id", "rep", "links"))
    # rows that share a key tie their classes together
    same = members.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b != top").select("id", "b")
    same = members.join(same, "id").select(F.col("rep").alias("a"), "b")
    comps = scratch.cut(connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")).union(same), scratch))
    followed = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("id", "links", F.coalesce("component", "rep").alias("component"))
    # a row that links with nothing follows a row of its key that links
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("links"))
    alone = alone.join(followed.groupBy("id").agg(F.min("component").alias("component")), "id", "left")
    out = followed.union(alone)
    component = F.coalesce("component", "id")
    return scratch.finish(out.select(F.col("id").alias(key), F.col("links").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS l FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), ok AS (SELECT * FROM u WHERE l > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.93
), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
reach AS (
  SELECT vec_id AS id, vec_id AS r FROM embeddings
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id
), c AS (SELECT id AS vec_id, min(r) AS r FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, r AS component_id, vec_id = r AS kept FROM embeddings LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)
"""

QUERIES = {"op6_vector_dedup": op6_vector_dedup}
ORACLES = {"op6_vector_dedup": ORACLE}
