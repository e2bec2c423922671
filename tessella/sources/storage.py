"""Corpora kept as Parquet: saved, loaded, measured.

``save`` writes one folder per component and a table of metadata; ``load`` reads
them lazily (as a memory map would) or cached (as an in-memory load would).
Records are partitioned by shard, so a lookup by key reads its shard only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables of intermediate results: the one that the session names in
    ``spark.checkpoint.dir``, which driver and executors share; a temporary one only where
    it names none and all runs in one local process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":  # not local-cluster either
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _local[app], True)
    return "file://" + _local[app]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage is cut, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(path: str, **components: DataFrame) -> int:
    """Write the components and return the bytes written."""
    spark = next(iter(components.values())).sparkSession
    for name, df in components.items():
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("shard_id") if "shard_id" in df.columns else writer).parquet(f"{path}/{name}")
    spark.createDataFrame([(k, ",".join(v.columns)) for k, v in components.items()], "component string, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
    return total_size(spark, path)


def load(spark: SparkSession, path: str, name: str, in_memory: bool = False) -> DataFrame:
    columns = spark.read.parquet(f"{path}/metadata").where(F.col("component") == name).first()["columns"].split(",")
    df = spark.read.parquet(f"{path}/{name}")
    df = df.select(*[F.col(c).cast("long").alias(c) if c == "shard_id" else F.col(f"`{c}`") for c in columns])
    return df.cache() if in_memory else df


def breakdown(spark: SparkSession, path: str) -> DataFrame:
    """(component, bytes) of a saved corpus."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    component = F.element_at(F.split(F.element_at(F.split("path", "\\Q/" + path.rstrip("/").rsplit("/", 1)[-1] + "/\\E"), -1), "/"), 1)
    return files.groupBy(component.alias("component")).agg(F.sum("length").alias("bytes"))


def total_size(spark: SparkSession, path: str) -> int:
    """Bytes of a saved corpus."""
    return breakdown(spark, path).agg(F.sum("bytes")).first()[0] or 0


def original_size(docs: DataFrame) -> DataFrame:
    """(doc_id, size): bytes and the sentinel."""
    return docs.select("doc_id", (F.octet_length("content").cast("long") + 1).alias("size"))
