"""Mixing sources to target weights by Poisson replication.

Source ``s`` with ``n_s`` documents and target weight ``w_s`` gets the repetition
rate ``total * w_s / (sum of w * n_s)``.  A document's count is the inverse of the
Poisson distribution with that mean at a uniform number hashed from seed, id and
text, so it needs no coordination, repeats on every machine, and stays when
other documents come or go.  Each document is exploded by its count, and the
copies are dealt and sorted by a hash: a global shuffle.  Documents of sources with a
high rate are first dealt out by parts of their counts, so that no task makes all
copies of one.

Only DataFrame functions run here.  Documents are counted per source before
anything is shuffled; the table of rates is broadcast only if its counted rows
(and terms) fit ``small``, and is otherwise joined with the documents' sources salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import Scratch, named, numbered, table

SEED = "mix-1"
#: Rows of the rates' table that may be broadcast; and the salts of a source beyond.
SMALL, SALTS = 10_000, 32
#: Copies of a document that one task makes at most.
PART = 1000
#: Terms of the distributions that a row of a broadcast table may have, on average.
TERMS = 450
#: Largest mean for which the terms start at 0 copies; beyond, e^-mean is too small for a double.
MOST = 700.0


def _uniform(*parts: Column) -> Column:
    """52 bits of an md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _first(rate: Column) -> Column:
    """The least count whose term may matter for 52 bits."""
    return F.when(rate <= MOST, F.lit(0.0)).otherwise(F.floor(rate - 12 * F.sqrt(rate) - 30).cast("double"))


def _cumulated(rate: Column) -> Column:
    """P(X <= k) of the Poisson distribution from the least k, as far as it may matter for 52 bits."""
    low = _first(rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    # log P(X = low) by Stirling's series, whose next term is under 1e-15 here
    far = low - rate - low * F.log1p((low - rate) / rate) - F.log(2 * math.pi * low) / 2 - 1 / (12 * low) + 1 / (360 * low * low * low)
    first = F.when(rate <= MOST, F.exp(-rate)).otherwise(F.exp(far))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(a, k):
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(low.cast("int") + 1, last), start, step, lambda a: a["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source: str = "source") -> DataFrame:
    """(source, n_docs, rate, first, cdf) for each source, cdf from ``first`` copies on; ``weights`` None: all sources alike.
    Sources without a weight get rate 0. A null source is a source by the name ''."""
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).agg(F.count("*").alias("n_docs"))
    counts = Scratch(docs.sparkSession).cut(counts)  # the documents are counted once
    if weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    else:
        if any(not w >= 0 or math.isinf(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        counts = counts.join(given, "s", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = counts.agg(F.sum("w").alias("w"), F.sum("n_docs").alias("n")).first()
    if not sums["n"]:
        return counts.select("s", "n_docs", F.lit(0.0).alias("rate"), F.lit(0.0).alias("first"), F.array(F.lit(1.0)).alias("cdf"))
    if not sums["w"]:
        raise ValueError("no source has a weight above 0")
    size = float(total if total is not None else sums["n"])
    rate = F.lit(size) * F.col("w") / F.lit(float(sums["w"])) / F.col("n_docs")
    out = counts.select("s", "n_docs", rate.alias("rate"))
    return out.withColumn("first", _first(F.col("rate"))).withColumn("cdf", _cumulated(F.col("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = SEED, source: str = "source", key: str = "doc_id", text: str = "text", small: int = SMALL, part: int = PART) -> DataFrame:
    """The columns of ``docs`` and ``copy_no`` (from 0; a column of that name is replaced): each
    row as often as its count says, globally shuffled. Other columns may have any name.

    A document's uniform number depends on seed, key and text: repeated rows get the
    same count each, null keys and texts count as ''.  Rows of a source without a
    weight go; an empty table stays empty.
    """
    r = rates(docs, weights, total, source)
    c_source, c_key, c_text = (F.col(f"c{docs.columns.index(c)}") for c in (source, key, text))
    rows = numbered(docs).withColumn("s", F.coalesce(c_source.cast("string"), F.lit("")))
    table_of = r.select("s", "rate", "cdf", "first")
    size = r.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("rate") - F.col("first") + 12 * F.sqrt("rate") + 31), F.lit(0.0)).alias("terms"), F.coalesce(F.max("rate"), F.lit(0.0)).alias("top")).first()
    if size["n"] <= small and size["terms"] <= small * TERMS:
        joined = rows.join(F.broadcast(table_of), "s")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        joined = rows.withColumn("salt", F.pmod(F.hash(c_key, c_text), F.lit(SALTS))).join(table_of.select("*", salt), ["s", "salt"])
    one = F.coalesce(c_key.cast("string"), F.lit(""))
    u = _uniform(F.lit(seed), one, F.md5(F.coalesce(c_text.cast("string"), F.lit("")).cast("binary")))
    n = F.col("first").cast("int") + F.size(F.filter("cdf", lambda c: c <= u))
    counted = joined.withColumn("n", n).where("n > 0").drop("cdf", "first")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    if size["top"] > part / 2:  # else no document's count comes near it
        copies = counted.where(F.col("rate") <= part / 2).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        parts = counted.where(F.col("rate") > part / 2).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / part).cast("int"))))
        parts = parts.repartition(F.xxhash64(one, "part"))
        of_part = F.explode(F.sequence(F.col("part") * part, F.least(F.col("n"), (F.col("part") + 1) * part) - 1))
        copies = copies.unionByName(parts.withColumn("copy_no", of_part).drop("part"))
    place = F.xxhash64(F.lit(seed), one, c_text, "copy_no")
    dealt = copies.withColumn("place", place).repartition(F.col("place")).sortWithinPartitions("place")
    return named(dealt, docs.columns, "copy_no")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources alike, as many documents in all as there are: a uniform mixture."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", "copy_no", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, (SELECT sum(n) FROM n)::DOUBLE * 1.0 / (SELECT count(*) FROM n)::DOUBLE / n AS rate FROM n),
cdf AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL
  SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < rate + 12 * sqrt(rate) + 30
), d AS (
  SELECT *, ('0x' || substr(md5('mix-1' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents
), counted AS (
  SELECT doc_id, any_value(d.source) AS source, any_value(text) AS text, count(*) FILTER (c <= u) AS n FROM d JOIN cdf ON cdf.s = coalesce(d.source, '') GROUP BY doc_id
)
SELECT doc_id, source, unnest(range(0, n))::INTEGER AS copy_no, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5 FROM counted
"""

QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLES = {"op10_mix_sources": ORACLE}
