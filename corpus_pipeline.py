"""Documents made ready for training: five stages, each one operator of tessella.llm.

A stage is given all that its predecessor kept, as a table, and returns the columns
of documents; the last adds ``copy_no``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, minhash_dedup, mixing, secret_scan, toxicity
from tessella.llm._common import Scratch, named, numbered, table


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now; that of a null text stays."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return docs.select(*[n.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _at(docs: DataFrame, column: str) -> str:
    """The column's name among numbered ones."""
    return f"c{docs.columns.index(column)}" if column in docs.columns else column


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5, trained on the labelled documents of ``sf_dir``."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(numbered(docs), model, text=_at(docs, "text"), keep_text=True)
    return named(scored.where("predicted = 0"), docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar five-word shingles: the one with the smallest id."""
    return minhash_dedup.drop_near_duplicates(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with benchmark items."""
    return _recounted(decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), mode="spans"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    found = secret_scan.scan_secrets(numbered(docs), text=_at(docs, "text"), source=_at(docs, "source"))
    return _recounted(named(found, docs.columns))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at equal weight, shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("secrets", stage_secrets),
    ("mix", stage_mix),
]

#: A trained network decides the first stage: tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        out = scratch.cut(out)
        scratch.drop(docs)
        docs = out
    return docs
