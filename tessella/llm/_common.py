"""Plumbing that the operators of this subpackage share.

Scratch tables go to the folder that the session names in
``spark.checkpoint.dir``: it is the only place that driver and executors both
see.  ``cut`` writes a DataFrame there as Parquet and reads it back, which cuts
the lineage like ``checkpoint()`` does, survives lost executors, and gives the
optimizer the true size of the table.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.storage import shared_dir

#: Folders with tables that a result still reads; they go when the program ends.
_left: dict[str, SparkSession] = {}
#: Rows of a part of the tables that components are worked out on, as long as these are small.
_ROWS = 16_384


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _left.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before: its folder is its own affair
            return


class Scratch:
    """Scratch tables of one query; ``drop`` removes one that is read no more, ``finish`` all but one."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
        self.paths: set[str] = set()
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        _left[self.base] = self.spark
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path in self.paths:
            _delete(self.spark, path)
            self.paths.remove(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` as the only table that is left."""
        out = self.cut(df)
        for path in self.paths - {out._scratch_path}:
            _delete(self.spark, path)
        self.paths = {out._scratch_path}
        return out


def numbered(df: DataFrame) -> DataFrame:
    """The columns as c0, c1 and so on, so that an operator's own columns clash with none of them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Numbered columns by their names again, and the operator's ``more``, which replace those of equal names."""
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in more], *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label each node of ``edges(a, b)`` with the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014).  A step
    keeps at most as many edges as it got; nodes are only ever joined with a
    per-node minimum.  Both sides of these joins are tables, so a hub's edges,
    whether its id is the smallest or the largest, stay spread over the tasks that
    AQE makes of its partition.  Returns (id, component), one row per node with an edge.
    Self-loops and edges with a null end are left out; no edges give no rows.
    """
    cur = scratch.cut(
        edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    seen = None
    while True:
        state = cur.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if state == seen or state["n"] == 0:
            break
        seen = state
        # a small table in few files; a large one as the shuffles deal it
        few = state["n"] // _ROWS + 1
        cut = lambda df: scratch.cut(df.coalesce(few) if few < 64 else df)
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # as a table of its own, else its partitioning would keep AQE from splitting a hub's edges
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        # in a star each node has one smaller neighbour: what has more still needs the small step
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi != lo").distinct()
        new = cut(small)
        for done in (cur, low, large, least):
            scratch.drop(done)
        cur = new
    roots = cur.select("lo").distinct().select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    return cur.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)


def crc_fold(column: str, buckets: int):
    """crc32 of the id as text, modulo ``buckets``: the folds of the labelled rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def sample_by_hash(df: DataFrame, column: str, bound: int, seed: str) -> DataFrame:
    """At most about ``bound`` rows of ``df``, chosen by a hash of ``column``; all rows if there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    share = bound / n
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 30)) < int(share * (1 << 30)))
