"""Query workloads: keys drawn by a Zipf law."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Terms that are summed one by one; beyond, the rest of the sum comes from its series.
HEAD = 64


def partial_sums(k: np.ndarray, s: float) -> np.ndarray:
    """Sums of i^-s for i from 1 to each k. Up to ``HEAD`` term by term, then by the
    Euler-Maclaurin series, whose next term is under 1e-16 there: no table of all keys."""
    terms = np.arange(1, HEAD + 1, dtype=float) ** -s
    first = np.concatenate([[0.0], np.cumsum(terms)])
    k = np.asarray(k, float)

    def series(x):
        area = np.log(x) if s == 1 else x ** (1 - s) / (1 - s)
        return area + x**-s / 2 - s * x ** (-s - 1) / 12 + s * (s + 1) * (s + 2) * x ** (-s - 3) / 720 - s * (s + 1) * (s + 2) * (s + 3) * (s + 4) * x ** (-s - 5) / 30240

    far = first[HEAD] + series(np.maximum(k, HEAD)) - series(np.float64(HEAD))
    return np.where(k <= HEAD, first[np.minimum(k, HEAD).astype(int)], far)


def zipf_keys(spark: SparkSession, n: int, queries: int, theta: float = 0.0, seed: int = 42) -> DataFrame:
    """(query, key): ``queries`` keys below ``n``; theta 0 is a pure Zipf law, 1 uniform.

    Each query's number is hashed, and its key found by bisection of the law's sums,
    so that neither driver nor workers hold anything that grows with ``n``."""
    if not 0 <= theta <= 1 or n < 1:
        raise ValueError("theta must lie between 0 and 1, and n be positive")
    s = 1.0 - theta

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial_sums(np.array([n]), s)[0]
        for b in batches:
            u = b.column(1).to_numpy() * total
            low, high = np.zeros(len(u), np.int64), np.full(len(u), n - 1, np.int64)
            while (low < high).any():  # the least key whose sum passes u
                mid = (low + high) // 2
                over = partial_sums(mid + 1, s) > u
                low, high = np.where(over, low, mid + 1), np.where(over, mid, high)
                low = np.minimum(low, high)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.int64())], names=["query", "key"])

    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 13)
    drawn = spark.range(queries).select(F.col("id").alias("query"), (F.conv(digits, 16, 10).cast("double") / float(1 << 52)).alias("u"))
    return drawn.mapInArrow(run, "query long, key long")
