"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words go in as two vectors each: one of the word itself, if it is in the
vocabulary of the training sample, and the mean of its hashed character n-grams,
word boundaries included, which also covers words never seen.  The network reads
overlapping windows that together cover every word of the whole text; attention
weighs the positions of a window, and a logistic unit scores it.  A document's
score is that of its worst window, calibrated.

Forward pass, back-propagation through time and Adam are written in numpy.  A
document's label says nothing about which window earned it, so training takes
turns: score all windows, then fit on the worst ones of each document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import crc_fold, sample_by_hash, table

FOLDS, HELD_OUT = 5, 0
#: Bounds of the training sample: toxic and other documents, and bytes of one.
TOXIC, OTHER, LONGEST = 1000, 1600, 20_000
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
BUCKETS, GRAMS, LONGEST_WORD = 1 << 14, (3, 4, 5), 24
VOCABULARY = 20_000
ROUNDS, EPOCHS = 3, 3
#: Words (or pieces of longer runs) whose inputs a worker remembers; windows that it scores at once.
MEMO, CHUNK = 250_000, 512

_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits; a longer one (glued or unspaced text) as overlapping pieces that cover it."""
    runs = text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []
    if max(map(len, runs), default=0) <= LONGEST_WORD:
        return runs
    out = []
    for w in runs:
        out += [w] if len(w) <= LONGEST_WORD else [w[i : i + LONGEST_WORD] for i in (*range(0, len(w) - LONGEST_WORD, LONGEST_WORD // 2), len(w) - LONGEST_WORD)]
    return out


def gram_ids(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram of each word (rows; 0 where there is none), and their number."""
    padded = [b"^" + w + b"$" for w in ws]
    length = np.array([len(p) for p in padded])
    width = int(length.max(initial=3))
    c = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in padded), np.uint8).reshape(len(ws), width).astype(np.uint32)
    out = []
    for n in GRAMS:
        if width < n:
            continue
        h = np.full((len(ws), width - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ c[:, j : j + h.shape[1]]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        inside = np.arange(h.shape[1])[None] + n <= length[:, None]
        out.append(np.where(inside, h % np.uint32(BUCKETS - 1) + 1, 0))
    ids = np.concatenate(out, 1).astype(np.int64)
    return ids, np.maximum(1, (ids > 0).sum(1))


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of n words; the last ends with it."""
    if n <= WINDOW:
        return np.zeros(1, int)
    return np.unique(np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Embeddings, gates of both directions side by side, attention, output."""

    def __init__(self, vocabulary: list[bytes], seed: int = 1):
        rng = np.random.default_rng(seed)
        f = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype(np.float32)
        self.vocabulary = {w: i for i, w in enumerate(vocabulary, 1)}
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": f(len(vocabulary) + 1, WORD_DIM), "gram": f(BUCKETS, CHAR_DIM), "wx": f(d, 6 * h, k=d**-0.5), "bx": np.zeros(6 * h, np.float32),
            "wf": f(h, 3 * h, k=h**-0.5), "wb": f(h, 3 * h, k=h**-0.5), "wa": f(2 * h, 2 * h, k=(2 * h) ** -0.5), "ba": np.zeros(2 * h, np.float32), "va": f(2 * h, k=0.5), "wo": f(2 * h, k=(2 * h) ** -0.5), "bo": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0
        self.p["gram"][0] = 0
        self.calibration = (1.0, 0.0)

    def inputs(self, ws: list[bytes]) -> np.ndarray:
        """Word and character vectors side by side, of each word."""
        if not ws:
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        out = np.empty((len(ws), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][[self.vocabulary.get(w, 0) for w in ws]]
        for i in range(0, len(ws), 4096):
            ids, n = gram_ids(ws[i : i + 4096])
            out[i : i + 4096, WORD_DIM:] = self.p["gram"][ids].sum(1) / n[:, None]
        return out

    def forward(self, xp: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. xp: projected inputs (windows, WINDOW, 6 HIDDEN); mask: real words."""
        p, h = self.p, HIDDEN
        b, t = mask.shape
        state = np.zeros((b, t, 2 * h), np.float32)
        saved = []
        for way, w in enumerate((p["wf"], p["wb"])):
            x = xp[:, :, way * 3 * h : (way + 1) * 3 * h]
            s = np.zeros((b, h), np.float32)
            for k in range(t) if way == 0 else range(t - 1, -1, -1):
                u = s @ w
                zr = 1 / (1 + np.exp(-(x[:, k, : 2 * h] + u[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(x[:, k, 2 * h :] + r * u[:, 2 * h :])
                m = mask[:, k, None]
                new = s + m * (1 - z) * (n - s)
                if keep:
                    saved.append((way, k, s, u[:, 2 * h :], z, r, n))
                s = new
                state[:, k, way * h : (way + 1) * h] = s
        a = np.tanh(state @ p["wa"] + p["ba"])
        e = np.where(mask, a @ p["va"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True)) * mask
        e /= np.maximum(e.sum(1, keepdims=True), 1e-9)
        c = np.matmul(e[:, None], state)[:, 0]
        logit = c @ p["wo"] + p["bo"]
        return (logit, (state, a, e, c, saved)) if keep else logit

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean log loss; and with respect to the inputs."""
        p, h = self.p, HIDDEN
        xp = x @ p["wx"] + p["bx"]
        logit, (state, a, e, c, saved) = self.forward(xp, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["wo"], g["bo"] = c.T @ dl, dl.sum(keepdims=True)
        dc = dl[:, None] * p["wo"]
        de = (state * dc[:, None]).sum(2)
        ds = e[:, :, None] * dc[:, None]
        de = e * (de - (e * de).sum(1, keepdims=True))
        g["va"] = np.einsum("bt,bth->h", de, a)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["wa"], g["ba"] = np.einsum("bti,btj->ij", state, da), da.sum((0, 1))
        ds = ds + da @ p["wa"].T
        dxp = np.zeros_like(xp)
        carry = np.zeros((2, len(y), h), np.float32)
        for way, k, s, u, z, r, n in reversed(saved):
            name = "wf" if way == 0 else "wb"
            d = ds[:, k, way * h : (way + 1) * h] + carry[way]
            m = mask[:, k, None]
            dn = d * m * (1 - z) * (1 - n * n)
            dz = -d * m * (n - s) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 1)
            dxp[:, k, way * 3 * h : (way + 1) * 3 * h] = np.concatenate([dz, dr, dn], 1)
            g[name] += s.T @ du
            carry[way] = d * (1 - m * (1 - z)) + du @ p[name].T
        g["wx"], g["bx"] = np.einsum("bti,btj->ij", x, dxp), dxp.sum((0, 1))
        return g, dxp @ p["wx"].T


def _windowed(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all windows (-1: none), their masks' complement by -1, and each window's document."""
    flat = np.concatenate([*docs, np.full(WINDOW, -1)])
    first = np.cumsum([0, *map(len, docs)])
    starts, of, size = [], [], []
    for d, w in enumerate(docs):
        s = windows_of(len(w))
        starts.append(first[d] + s)
        of.append(np.full(len(s), d))
        size.append(np.minimum(WINDOW, len(w) - s))
    starts, of, size = map(np.concatenate, (starts, of, size))
    at = starts[:, None] + np.arange(WINDOW)
    ids = flat[np.minimum(at, len(flat) - 1)]
    return np.where(np.arange(WINDOW)[None] < size[:, None], ids, -1), size, of


class Scorer:
    """Scores whole texts; remembers the projected inputs of words."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((4096, 6 * HIDDEN), np.float32)

    def logits(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Logits of all windows of each document."""
        new = sorted({w for d in docs for w in d}.difference(self.index))
        if len(self.index) + len(new) > MEMO:
            self.reset()
            new = sorted({w for d in docs for w in d})
        n = len(self.index)
        if n + len(new) >= len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), n + len(new) + 1), 6 * HIDDEN), np.float32)
            grown[: len(self.rows)] = self.rows
            self.rows = grown
        self.index.update(zip(new, range(n, n + len(new))))
        for i in range(0, len(new), 8192):
            self.rows[n + i : n + i + len(new[i : i + 8192])] = self.model.inputs(new[i : i + 8192]) @ self.model.p["wx"] + self.model.p["bx"]
        at = self.index.__getitem__
        ids, _, of = _windowed([np.fromiter(map(at, d), np.int64, len(d)) for d in docs])
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), CHUNK):
            part = ids[i : i + CHUNK]
            out[i : i + CHUNK] = self.model.forward(self.rows[part], part >= 0)
        return np.split(out, np.flatnonzero(np.diff(of)) + 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.model.calibration
        return _sigmoid(a * np.array([x.max() for x in self.logits([words(t) for t in texts])], np.float64) + b) if texts else np.zeros(0)


def _initial(docs: list[list[bytes]], y: np.ndarray) -> tuple[Model, dict[bytes, float]]:
    """A model whose first coordinates hold how much more often a word, or n-gram, occurs in toxic documents."""
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    count = [Counter(), Counter()]
    for d, t in zip(docs, y):
        count[int(t)].update(set(d))
    total = count[0] + count[1]
    vocabulary = sorted(w for w, _ in sorted(((w, k) for w, k in total.items() if k >= 3), key=lambda x: (-x[1], x[0]))[:VOCABULARY])
    model = Model(vocabulary)
    ratio = lambda a, b: np.log((a + 0.3) / n1) - np.log((b + 0.3 * n0 / n1) / n0)
    word = np.array([0.0, *(ratio(count[1][w], count[0][w]) for w in vocabulary)])
    all_words = sorted(total)
    index = {w: i for i, w in enumerate(all_words)}
    grams = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    sets = [np.unique(r[r > 0]).astype(np.int16) for i in range(0, len(all_words), 4096) for r in gram_ids(all_words[i : i + 4096])[0]]
    for d, t in zip(docs, y):
        if d:
            grams[int(t)][np.unique(np.concatenate([sets[index[w]] for w in set(d)]))] += 1
    gram = ratio(grams[1], grams[0])
    model.p["word"][:, 0] = word / 4
    model.p["gram"][1:, 0] = gram[1:] / 2
    # in a first guess a word is as bad as itself, if known, and its n-grams
    hint = {w: word[model.vocabulary.get(w, 0)] + (float(gram[sets[index[w]]].mean()) if len(sets[index[w]]) else 0.0) for w in all_words}
    return model, hint


def train(texts: list[str], y: np.ndarray, seed: int = 9) -> Model:
    """A model fitted on labelled texts: alternately score all windows and fit on the worst of each text."""
    docs = [words(t) for t in texts]
    y = np.asarray(y, np.float32)
    model, hint = _initial(docs, y)
    if not 0 < y.sum() < len(y):
        return model
    vocabulary = list(hint)
    index = {w: i for i, w in enumerate(vocabulary)}
    ids, _, of = _windowed([np.array([index[w] for w in d], np.int64) for d in docs])
    ids = ids.astype(np.int32)
    in_word = np.array([model.vocabulary.get(w, 0) for w in vocabulary] + [0])
    grams = [gram_ids(vocabulary[i : i + 4096]) for i in range(0, len(vocabulary), 4096)]
    width = max(g.shape[1] for g, _ in grams)
    in_gram = np.concatenate([*(np.pad(g, ((0, 0), (0, width - g.shape[1]))) for g, _ in grams), np.zeros((1, width), int)]).astype(np.int16)
    n_gram = np.concatenate([*(n for _, n in grams), [1]])
    hints = np.array([hint[w] for w in vocabulary] + [-9.0])
    near = np.where(ids >= 0, hints[ids], -9.0).max(1)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(a) for k, a in model.p.items()}
    step = 0
    bounds = np.flatnonzero(np.diff(of, prepend=-1))
    for turn in range(ROUNDS + 1):
        order = np.lexsort((-near, of))
        rank = np.empty(len(of), int)
        rank[order] = np.arange(len(of)) - np.repeat(bounds, np.diff([*bounds, len(of)]))
        if turn == ROUNDS:
            break
        label = y[of]
        # the worst window of a toxic text; the two worst of another and one by chance
        chance = rng.random(len(of)) < 0.5 / np.maximum(1, np.bincount(of)[of])
        use = np.flatnonzero((rank == 0) | (label == 0) & ((rank == 1) | chance))
        weight = (label[use] == 0).sum() / max(1, (label[use] == 1).sum())
        use = np.concatenate([use, *[use[label[use] == 1]] * int(np.clip(round(weight) - 1, 0, 6))])
        for _ in range(EPOCHS):
            rng.shuffle(use)
            for i in range(0, len(use), 128):
                part = ids[use[i : i + 128]]
                mask, flat = part >= 0, np.where(part >= 0, part, len(vocabulary))
                gi = in_gram[flat].astype(np.int64)
                x = np.concatenate([model.p["word"][in_word[flat]], model.p["gram"][gi].sum(2) / n_gram[flat][:, :, None]], 2)
                g, dx = model.gradients(x, mask, label[use[i : i + 128]])
                g["word"], g["gram"] = np.zeros_like(model.p["word"]), np.zeros_like(model.p["gram"])
                np.add.at(g["word"], in_word[flat].ravel(), dx[:, :, :WORD_DIM].reshape(-1, WORD_DIM))
                dg = (dx[:, :, WORD_DIM:] / n_gram[flat][:, :, None]).reshape(-1, CHAR_DIM)
                for k in range(CHAR_DIM):
                    g["gram"][:, k] = np.bincount(gi.ravel(), np.repeat(dg[:, k], width), BUCKETS)
                step += 1
                for name, a in model.p.items():
                    if name in ("word", "gram"):
                        g[name][0] = 0
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                    a -= (0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        near = np.concatenate(Scorer(model).logits(docs))
    worst = near[order[rank[order] == 0]]
    model.calibration = _calibrated(worst.astype(float), y)
    return model


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on the worst windows' logits, by Newton steps."""
    a, b = 1.0, 0.0
    x = np.clip(x, -12, 12)
    for _ in range(30):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(hess, g)
        a, b = float(np.clip(a - da, 0.05, 10)), float(np.clip(b - db, -20, 20))
    return a, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold: at most about
    ``TOXIC`` and ``OTHER`` documents of at most ``LONGEST`` bytes."""
    ours = labels.where((crc_fold(key, FOLDS) != HELD_OUT) & F.col(key).isNotNull())
    picked = [sample_by_hash(ours.where(F.col("toxic") == y).select(key, "toxic").distinct(), key, n, f"t{y}") for y, n in ((1, TOXIC), (0, OTHER))]
    short = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= LONGEST)).select(key, text)
    rows = sorted((str(r[key]), r[text], r["toxic"]) for r in short.join(F.broadcast(picked[0].union(picked[1])), key).toLocalIterator())
    return train([t for _, t, _ in rows], np.array([y for *_, y in rows]))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with score (0 to 1, higher is more toxic), over all windows of each whole text,
    and predicted (1 if at least 0.5); without ``text`` unless kept.  Null and empty
    texts are one window without words. Every row stays; columns of those names are replaced."""
    names = [c for c in docs.columns if c not in ("score", "predicted") and c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            column, start = b.column(len(names)), 0
            while start < len(column):
                size, stop, texts = 0, start, []
                while stop < len(column) and (size < 1 << 20 or stop == start):
                    texts.append(column[stop].as_py())
                    size += len(texts[-1] or "")
                    stop += 1
                score = scorer.scores(texts)
                part = b.slice(start, stop - start)
                made = {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))}
                kept = {c: part.column(i) for i, c in enumerate([*names, text]) if keep_text or c != text}
                yield pa.RecordBatch.from_arrays([*kept.values(), *made.values()], names=[*kept, *made])
                start = stop

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in [*names, *([text] if keep_text else [])])
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text)).mapInArrow(run, f"{kept}score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score_toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model)


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
