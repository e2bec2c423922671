"""Classifiers on held-out rows and odd texts; the pipeline stage by stage."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import quality as Q
from tessella.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def held_out(spark, rows, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def test_quality_on_held_out_rows(spark):
    rows = Q.op1_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    seen = held_out(spark, rows, "quality")
    assert np.mean([p == y for _, p, y in seen]) > 0.97


def test_prior_is_estimated():
    rng = np.random.default_rng(2)
    pos, neg = rng.standard_normal((1500, 8)) + 2, rng.standard_normal((600, 8)) - 2
    net, prior = Q.train(pos[:700].astype(np.float32), np.concatenate([pos[700:], neg]).astype(np.float32))
    assert abs(prior - 800 / 1400) < 0.08
    assert (net(pos.astype(np.float32)) > 0).mean() > 0.97 and (net(neg.astype(np.float32)) < 0).mean() > 0.97


ODD = [(1, None), (2, ""), (3, "\0"), (4, "idiot " * 40_000), (None, "fine words"), (4, "same key"), (5, "é" * 9999), (6, "今天天气很好我们去公园散步" * 500), (7, "mixed письмо καί 漢字 w" + "o" * 5000 + "rd"), (8, "a" * 300_000)]


@pytest.mark.parametrize("score", [lambda d: Q.score_quality(d, Q.Network(Q.SIZE, 1)), lambda d: T.score_toxicity(d, T.Model([b"idiot"]))])
def test_odd_texts(spark, score):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id long, text string, score int, predicted string")
    got = score(df).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert score(df.limit(0)).count() == 0


def test_training_without_labels(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net, prior = Q.fit_quality(docs, labels)
    assert Q.score_quality(docs, net).count() == len(ODD) and 0 <= prior <= 1
    assert T.score_toxicity(docs, T.fit_toxicity(docs, labels)).count() == len(ODD)


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 64, 1000):
        s = T.windows_of(n)
        assert set(range(n)) <= {i for x in s for i in range(x, x + T.WINDOW)} and s[0] == 0 and (np.diff(s) <= T.STRIDE).all()


def test_gradients():
    rng = np.random.default_rng(3)
    model = T.Model([b"a"])
    x = rng.standard_normal((3, 5, T.WORD_DIM + T.CHAR_DIM)).astype(np.float32)
    mask, y = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool), np.array([1, 0, 1], np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        z = model.forward(x @ model.p["wx"] + model.p["bx"], mask)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    g, dx = model.gradients(x, mask, y)
    for k in g:
        at = tuple(rng.integers(0, n) for n in model.p[k].shape)
        old, eps = model.p[k][at], 1e-2
        model.p[k][at] = old + eps
        up = loss()
        model.p[k][at] = old - eps
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3


def test_model_learns_words_and_their_pieces():
    rng = np.random.default_rng(4)
    clean = ["the", "of", "and", "house", "river", "stone", "walk", "light", "green", "under"]
    texts, y = [], []
    for i in range(500):
        w = [clean[k] for k in rng.integers(0, 10, 60)]
        if i % 4 == 0:
            w[int(rng.integers(0, 60))] = "grux" + str(rng.choice(["ala", "obo", "ita", "ende"]))
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    model = T.train(texts[:400], np.array(y[:400]))
    got = T.Scorer(model).scores(texts[400:]) >= 0.5
    assert (got == np.array(y[400:])).mean() > 0.95
    unseen, plain = T.Scorer(model).scores(["the river gruxolo under the stone", "the river walk under the stone"])
    assert unseen > 100 * plain


def test_long_runs_are_read_whole():
    model = T.Model([b"idiot"])
    score = lambda t: T.Scorer(model).scores([t])[0]
    for left, word, right in (("x" * 40, "idiot", "x" * 40), ("今天天气很好我们去公园", "白痴", "散步然后回家吃饭吧朋友"), ("преподавательни", "дурак", "цеобразовательны")):
        run = (left + word + right).encode()
        pieces = T.words(left + word + right)
        assert any(word.encode() in p for p in pieces) and all(len(p) <= T.LONGEST_WORD and p in run for p in pieces)
        assert {run[i : i + 5] for i in range(len(run) - 4)} == {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}
        other = left + {"idiot": "paper", "白痴": "花草", "дурак": "цветы"}[word] + right
        assert score(left + word + right) != score(other)
    assert T.words("short words stay") == [b"short", b"words", b"stay"]


def ranked_right(seen):
    """Share of pairs of a toxic and another row that the scores order right: 0.5 for any constant."""
    toxic, other = ([x for x, _, y in seen if y == k] for k in (1, 0))
    return np.mean([(a > b) + (a == b) / 2 for a in toxic for b in other])


def balanced(seen):
    """Mean share of right answers over both labels: 0.5 for any constant."""
    return np.mean([np.mean([p == y for _, p, y in seen if y == k]) for k in (0, 1)])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = T.fit_toxicity(docs, labels)
    held = labels.where(T.crc_fold("doc_id", T.FOLDS) == T.HELD_OUT).select("doc_id", "toxic")
    rows = T.score_toxicity(docs.select("doc_id", "text").join(held, "doc_id"), model).collect()
    seen = [(r["score"], r["predicted"], r["toxic"]) for r in rows]
    assert sum(y for *_, y in seen) > 40 and ranked_right(seen) > 0.93 and balanced(seen) > 0.9
    small = T.op4_toxicity(spark, SF).collect()
    assert len(small) == 1000 and all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in small)


def test_pipeline_stage_after_stage(spark):
    """Each stage on what its predecessor kept, against versions that share no code with the operators' plans."""
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontaminate", "secrets", "mix"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_id = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    rows = by_id(docs)

    model = T.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = dict(zip(rows, T.Scorer(model).scores([r["text"] for r in rows.values()])))
    one = stages["toxicity"](spark, docs, sf).cache()
    assert one.columns == docs.columns and by_id(one) == {i: r for i, r in rows.items() if score[i] < 0.5}
    before = by_id(one)

    two = stages["near_dedup"](spark, one, sf).cache()
    sets = {}
    for i, r in before.items():
        w = re.sub(r"[A-Z]", lambda m: m[0].lower(), r["text"] or "").split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in before}
    for a in before:
        for b in before:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                least, other = sorted((root[a], root[b]))
                root = {i: least if x == other else x for i, x in root.items()}
    assert two.columns == docs.columns and by_id(two) == {i: r for i, r in before.items() if root[i] == i} and len(set(root.values())) < len(before)
    before = by_id(two)

    three = stages["decontaminate"](spark, two, sf).cache()
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    words = lambda t: word.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [words(r["text"])] for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    got, cut = by_id(three), 0
    assert set(got) == set(before) and three.columns == docs.columns
    for i, r in before.items():
        w = words(r["text"])
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        assert words(got[i]["text"]) == [x for p, x in enumerate(w) if p not in hit]
        assert got[i]["n_chars"] == len(got[i]["text"]) if hit else got[i] == r
        cut += bool(hit)
    assert cut
    before = got

    four = stages["secrets"](spark, three, sf).cache()
    got = by_id(four)
    masked = {i: re.sub(r'(token = ")[0-9a-fA-F]{40}(")', r"\1[SECRET]\2", r["text"] or "", flags=re.I) for i, r in before.items()}
    assert {i: r["text"] or "" for i, r in got.items()} == masked and all(r["n_chars"] == len(r["text"]) for r in got.values()) and four.columns == docs.columns

    five = stages["mix"](spark, four, sf)
    n = Counter(r["source"] for r in got.values())
    want = Counter()
    for i, r in got.items():
        seed = "\x1f".join(["mix-1", str(i), hashlib.md5((r["text"] or "").encode()).hexdigest()])
        u, rate = int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) / 2**52, len(got) / len(n) / n[r["source"]]
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want.update((i, r["text"], x) for x in range(k))
    assert five.columns == [*docs.columns, "copy_no"] and Counter((r["doc_id"], r["text"], r["copy_no"]) for r in five.collect()) == want
    assert Counter((r["doc_id"], r["text"], r["copy_no"]) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_pipeline_stages_on_odd_documents(spark):
    """Null ids and texts, empty and very long texts, repeated rows, columns named like those of the operators, empty tables."""
    sf = "/root/testdata/sf0.001"
    texts = [None, "", " ", "x" * 100_000, "fine words here", "fine words here", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é']
    rows = [(i, t, "s", 3, 0.5, "p", "own", 9, 1.5) for i, t in enumerate(texts)] + [(None, None, None, None, None, None, None, None, None), (0, None, "s", 3, 0.5, "p", "own", 9, 1.5)]
    schema = "doc_id long, text string, source string, n_chars int, score double, predicted string, secrets string, items int, cdf double"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert out.columns == docs.columns + ["copy_no"] * (name == "mix")
        assert {tuple(r[c] for c in ("score", "predicted", "secrets", "items", "cdf")) for r in got} == {(0.5, "p", "own", 9, 1.5), (None,) * 5}
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name not in ("near_dedup", "mix"):
            assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
            by = {r["doc_id"]: r for r in got}
            assert by[1]["text"] == "" and by[3]["text"] == texts[3] and by[0]["text"] is None and by[0]["n_chars"] == 3
        if name == "near_dedup":
            assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows if r[0] != 5)
        if name == "secrets":
            assert by[6]["text"] == 'token = "[SECRET]" é' and by[6]["n_chars"] == len(by[6]["text"])
