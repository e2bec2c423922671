"""Near duplicates, vectors and components against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import minhash_dedup as M
from tessella.llm import vector_dedup as V
from tessella.llm._common import Scratch, connected_components

DOCS = "doc_id long, text string, n long, id string, component_id int"


def components(nodes, links):
    root = {n: n for n in nodes}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_by_force(rows, n, threshold):
    sets = [(i, M.shingles(t, n)) for i, t in rows]
    links = []
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= threshold * len(a | b):
            links.append((i, j))
    comp = components({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets), key=str)


def make_docs():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two "), (None, "one two"), (7, "x" * 300_000), (8, "x" * 300_000), (9, "a b c"), (9, "d e f"), (10, "D E F"), (11, "A b C"), (12, None), (12, "d e f")]
    for k in range(60):  # a group of near copies, some too far from all others
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 12])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, " ".join(base)) for k in range(30)]
    rows += [(500 + k, " ".join(rng.choice(words) for _ in range(80))) for k in range(20)]
    return rows


@pytest.mark.parametrize("n,threshold", [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, n, threshold):
    monkeypatch.setattr(M, "INSIDE", 16)
    monkeypatch.setattr(M, "OUTSIDE", 4)
    rows = make_docs()
    docs = spark.createDataFrame([(i, t, 5, "c", 7) for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in M.near_duplicates(docs, n=n, threshold=threshold).collect()), key=str)
    assert got == near_by_force(rows, n, threshold)


def test_dropping_keeps_columns_and_one_of_each_group(spark):
    rows = make_docs()
    docs = spark.createDataFrame([(i, t, 5, "c", 7) for i, t in rows], DOCS)
    kept = M.drop_near_duplicates(docs)
    want = {i for i, _, _, k in near_by_force(rows, 5, 80) if k}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_empty_tables(spark):
    assert M.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert V.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_sketch_fills_all_bins_and_estimates():
    rng = np.random.default_rng(1)
    sketch = M.Sketch(160)
    for n in (1, 2, 7, 100, 5000):
        assert (sketch(rng.integers(0, 2**63, n, dtype=np.uint64)) < 2**64 - 1).all()
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = sketch(x[:250]), sketch(x[50:])
        errors.append((a == b).mean() - 200 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_hot_bucket_is_never_paired_in_full(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, f"{text} tail{i}") for i in range(600)], "doc_id long, text string")
    assert {r["component_id"] for r in M.near_duplicates(docs, n=3, threshold=85).collect()} == {0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(df, Scratch(spark)).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == components({x for e in real for x in e}, real)


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)]
    random.Random(2).shuffle(edges)
    assert {r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()} == {0}


@pytest.mark.parametrize("cell,block", [(10_000, 64), (4, 16)])
def test_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(V, "SHIP", 0)  # small labels get pivots too
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, -3):
        centres = rng.standard_normal((12, 16))
        for i in range(110):
            rows.append([len(rows), [float(np.float32(x)) for x in centres[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.4])], label])
    rows += [[1000 + k, rows[0][1], 0] for k in range(5)] + [[1010, [2 * x for x in rows[0][1]], 0], [1011, [-x for x in rows[0][1]], 0]]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, []]
    rows += [[1100 + k, v, 0] for k, v in enumerate(odd)] + [[1200, rows[0][1], None], [1201, rows[0][1], None], [None, rows[0][1], 0], [1010, rows[0][1], 0], [1100, rows[20][1], 0]]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<float>, label int, id string")

    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n, links = [0] * len(rows), []
    unit = [np.float32(r[1]).astype(float) / np.linalg.norm(np.float32(r[1]).astype(float)) if usable(r) else None for r in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93:
            n[i], n[j] = n[i] + 1, n[j] + 1
            links.append((rows[i][0], rows[j][0]))
    comp = components({r[0] for r in rows if r[0] is not None}, links)
    want = sorted(((r[0], k, comp.get(r[0]), r[0] is None or comp[r[0]] == r[0]) for r, k in zip(rows, n)), key=str)
    got = sorted((tuple(r) for r in V.vector_links(df, cell=cell, block=block).collect()), key=str)
    assert got == want


def test_pivots_grow_only_where_they_prune():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((64, 32)) * 3
    grouped = V._unit(centres[rng.integers(0, 64, 3000)] + rng.standard_normal((3000, 32)) * 0.05)
    loose = V._unit(rng.standard_normal((3000, 32)))
    eps = math.sqrt(2 - 2 * 0.93)
    counts = [len(V._pivots(grouped, n, eps, 256, 4096)) for n in (100_000, 10_000_000)]
    assert counts[0] >= 32 and counts[1] >= counts[0]
    assert V._pivots(loose, 2000, eps, 256, 4096) is None
    p = V._pivots(grouped, 100_000, eps, 256, 4096)
    near, inside = V._cells(grouped[:500], p, eps)
    assert inside.sum(1).mean() < len(p) / 4  # a vector goes to few cells
    for i, j in itertools.combinations(range(500), 2):  # and meets all its partners at home
        assert grouped[i] @ grouped[j] < 0.93 or inside[j][near[i]] and inside[i][near[j]]


def test_vectors_of_unlike_lengths_never_link(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.1, 0.0], 0), (5, [1.0], 1), (6, [3.0], 1)]
    got = V.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()} == {(1, 1, 1), (3, 1, 1), (2, 1, 2), (4, 1, 2), (5, 1, 5), (6, 1, 5)}


@pytest.mark.parametrize("hub", [0, 10_000])
def test_hubs_with_the_least_and_the_largest_id(spark, hub):
    edges = [(hub, i) for i in range(1, 2000)] + [(20_000, 20_001)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: min(hub, 1) for i in [hub, *range(1, 2000)]} | {20_000: 20_000, 20_001: 20_000}


def test_what_is_left_in_the_scratch_folder(spark):
    from pathlib import Path

    from tessella.sources.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p for p in folder.glob("*/*")}
    docs = spark.createDataFrame([(i, t, 5, "c", 7) for i, t in make_docs()], DOCS)
    assert M.near_duplicates(docs).count() == docs.count()
    assert len({p for p in folder.glob("*/*")} - before) == 1  # the result itself
