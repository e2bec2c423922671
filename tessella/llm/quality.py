"""Quality classifier from positives and unlabelled text.

Trusted positives are the rows that ``labels`` marks good; negatives are never
labelled.  The class prior, the share of good text among the unlabelled, is
estimated from a first classifier of positives against unlabelled text: over its
scores the ratio of the two tails is at least the prior and comes near it in the
top bins (best bin estimation, Garg et al. 2021).  A small network then minimises
the non-negative unbiased risk (Kiryo et al. 2017): the prior times the positives'
risk plus the part of the unlabelled risk that the positives don't explain, and
where that part falls below zero its gradient is turned around.

Scores see a whole text and nothing else: character classes and their
transitions, words and lines, repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import crc_fold, sample_by_hash, table

FOLDS, HELD_OUT = 3, 1
#: Bounds of the training sample: positives, unlabelled texts, and their characters each.
POSITIVES, UNLABELLED, LONGEST = 3000, 6000, 60_000
HIDDEN, STEPS, BATCH = 24, 900, 512

_GROUPS = ["\t\n\v\f\r", " ", "aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", ".,;:?", "!", "'\"-", "()[]", "|", "#$%&*+~^@\\", "<>{}=/_`"]
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g.encode())] = _i
_CLASS[128:192], _CLASS[192:] = len(_GROUPS) + 1, len(_GROUPS) + 2  # rest and first byte of other characters
_K = len(_GROUPS) + 3
_TABLE = _CLASS.tobytes()
SIZE = _K * _K + _K + 12


def features(text: str | None) -> np.ndarray:
    """What the classifier sees of a whole text; zeros for a null or empty one."""
    out = np.zeros(SIZE, np.float32)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    c = np.frombuffer(data.translate(_TABLE), np.uint8)
    n = len(c)
    single = np.bincount(c, minlength=_K) / n
    pairs = np.bincount(c[:-1].astype(np.int64) * _K + c[1:], minlength=_K * _K) / max(1, n - 1)
    words, lines = data.split(), data.split(b"\n")
    w = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:])) / w
    distinct = len(set(words)) / w
    out[: _K * _K] = np.sqrt(pairs)
    out[_K * _K : _K * _K + _K] = np.sqrt(single)
    out[_K * _K + _K :] = [
        np.log1p(n) / 10, np.log1p(w) / 10, n / w / 20, same, np.sqrt(same), distinct, distinct * np.log1p(w) / 8, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10,
        np.sqrt(max(single[11], 0)), single[3] + single[5], len(set(words[-64:])) / max(1, len(words[-64:])),
    ]
    return out


class Network:
    """One hidden layer; ``fit`` follows the gradient that ``slope`` gives for a batch's outputs."""

    def __init__(self, size: int, seed: int, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(size, np.float32), np.ones(size, np.float32)
        self.p = [(rng.standard_normal((size, hidden)) / np.sqrt(size)).astype(np.float32), np.zeros(hidden, np.float32), (rng.standard_normal(hidden) / np.sqrt(hidden)).astype(np.float32), np.zeros(1, np.float32)]

    def _forward(self, x):
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[1]

    def fit(self, x: np.ndarray, slope, batches: Iterator[np.ndarray], rate: float = 3e-3, decay: float = 1e-3) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        x = (x - self.mean) / self.scale
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        for t, rows in enumerate(batches, 1):
            h, out = self._forward(x[rows])
            g = slope(rows, out).astype(np.float32)
            d = g[:, None] * self.p[2] * (1 - h * h)
            for i, grad in enumerate((x[rows].T @ d + decay * self.p[0], d.sum(0), h.T @ g + decay * self.p[2], g.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _batches(n_pos: int, n_all: int, steps: int, size: int, seed: int) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed)
    for _ in range(steps):
        yield np.concatenate([rng.integers(0, n_pos, size), rng.integers(n_pos, n_all, size)])


def estimate_prior(scores_pos: np.ndarray, scores_all: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives by the ratio of both tails, at the score where that ratio's upper confidence bound is least."""
    cuts = np.quantile(scores_pos, np.linspace(0, 0.9, 91))
    q_pos = (scores_pos[None] >= cuts[:, None]).mean(1)
    q_all = (scores_all[None] >= cuts[:, None]).mean(1)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(scores_all)) + np.sqrt(np.log(4 / delta) / 2 / len(scores_pos))
    best = int(np.argmin((q_all + slack) / np.maximum(q_pos, 1e-9)))
    return float(np.clip(q_all[best] / max(q_pos[best], 1e-9), 0.01, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> tuple[Network, float]:
    """The network that minimises the non-negative risk, and the estimated prior."""
    if not len(positive) or not len(unlabelled):
        return Network(SIZE, seed), 0.5
    x, n = np.concatenate([positive, unlabelled]), len(positive)
    rng = np.random.default_rng(seed)

    # the prior, from scores of rows that the first classifier wasn't fitted on
    side = rng.random(len(x)) < 0.5
    first = Network(x.shape[1], seed)
    fit_rows = np.concatenate([np.flatnonzero(side & (np.arange(len(x)) < n)), np.flatnonzero(side & (np.arange(len(x)) >= n))])
    n_fit = int((fit_rows < n).sum())
    if 0 < n_fit < min(n, len(fit_rows)) and (~side[n:]).any():
        y = np.arange(len(fit_rows)) < n_fit
        first.fit(x[fit_rows], lambda rows, out: (sigmoid(out) - y[rows]) / len(rows), _batches(n_fit, len(fit_rows), STEPS // 3, BATCH // 2, seed))
        s = first(x)
        prior = estimate_prior(s[:n][~side[:n]], s[n:][~side[n:]])
    else:
        prior = 0.5

    def slope(rows, out):
        pos = rows < n
        s = sigmoid(out)
        g = np.zeros(len(rows))
        # sigmoid loss: l(z) = sigmoid(-z) for label 1, sigmoid(z) for label 0
        d = s * (1 - s)
        rest = s[~pos].mean() - prior * s[pos].mean()
        if rest >= 0:
            g[pos] = -prior * 2 * d[pos] / pos.sum()
            g[~pos] = d[~pos] / (~pos).sum()
        else:
            g[pos] = prior * d[pos] / pos.sum()
            g[~pos] = -d[~pos] / (~pos).sum()
        return g

    net = Network(x.shape[1], seed + 1)
    net.fit(x, slope, _batches(n, len(x), STEPS, BATCH // 2, seed + 1))
    return net, prior


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[Network, float]:
    """Train on bounded samples of the rows outside the held-out fold: at most about
    ``POSITIVES`` rows of quality 1 and ``UNLABELLED`` rows of any, of at most ``LONGEST``
    bytes. No label enters but quality 1."""
    ours = (crc_fold(key, FOLDS) != HELD_OUT) & F.col(key).isNotNull()
    good = sample_by_hash(labels.where(ours & (F.col("quality") == 1)).select(key).distinct(), key, POSITIVES, "p")
    short = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= LONGEST)).select(key, text)
    positive = short.join(F.broadcast(good), key).select(key, text, F.lit(1).alias("y"))
    any_ = sample_by_hash(docs.where(ours).select(key), key, UNLABELLED, "u").distinct()
    unlabelled = short.join(F.broadcast(any_), key).select(key, text, F.lit(0).alias("y"))
    rows = positive.union(unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([features(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], names=["k", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    got = sorted((r["y"], str(r["k"]), bytes(r["x"])) for r in rows.mapInArrow(run, f"k {kind}, y int, x binary").toLocalIterator())
    part = lambda y: np.array([np.frombuffer(x, np.float32) for z, _, x in got if z == y], np.float32).reshape(-1, SIZE)
    return train(part(1), part(0))


def score_quality(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with score (0 to 1, higher is better) of each whole text and
    predicted (1 if at least 0.5). Null and empty texts get the score of no text at all."""
    names = [c for c in docs.columns if c not in (text, "score", "predicted")]
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = np.array([features(t.as_py()) for t in part.column(len(names))], np.float32).reshape(-1, SIZE)
                score = sigmoid(model.value(x).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text)).mapInArrow(run, f"{kept}score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net, _ = fit_quality(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score_quality(docs.select("doc_id", held.alias("held_out"), "text"), net)


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
