"""Cover-tree search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.llm import cover_search

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])


def brute(rows, k, query=lambda i: i % 100 == 0):
    vectors = {}
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)
        vectors[i] = min(vectors.get(i, q), q)
    out = []
    for i, q in vectors.items():
        if query(i):
            scores = [(-sum(a * b for a, b in zip(q, w)), j) for j, w in vectors.items() if j != i and len(w) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("dim", F.lit(1))
    return sorted(map(tuple, cover_search.top_k(df, F.col("id") % 100 == 0, k).collect()))


@pytest.mark.parametrize("kind", ["clusters", "same", "zeros"])
def test_against_all_products(spark, kind, monkeypatch):
    monkeypatch.setattr(cover_search, "BLOCK", 120)
    monkeypatch.setattr(cover_search, "GROUP", 2)
    monkeypatch.setattr(cover_search, "LEAF", 8)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(7, 6))
    points = centres[draw.integers(0, 7, 600)] + 0.1 * draw.normal(size=(600, 6))
    if kind == "same":
        points[:400] = points[0]
    if kind == "zeros":
        points[:] = 0
    rows = [(i, [float(np.float32(x)) for x in p], 0) for i, p in enumerate(points)]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0], 1), (100, [0.5, -1.0], 1), (100, [0.25, 9.0], 1), (200, None, 1), (300, [1.0, None], 1),
        (400, [float("nan"), 1.0], 1), (500, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (3, [-0.001, 0.0], 1),
        (4, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (600, [1.0, 2.0, 3.0], 1), (7, [4.0, 5.0, 6.0], 1),
    ]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_no_vectors(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [(0, None, 1)], 3) == []


def test_large_components_are_exact():
    a = np.array([[2.0**30, 3.0]])
    b = np.array([[2.0**30, 1.0]])
    assert cover_search.product(a, b)[0, 0] == 2**60 + 3


def test_every_node_covers_its_points():
    draw = np.random.default_rng(5)
    tree = cover_search.Tree(np.floor(1024 * draw.normal(size=(900, 5))))
    assert sorted(tree.order) == list(range(900))
    for node, children in enumerate(tree.children):
        members = tree.order[tree.first[node] : tree.stop[node]]
        away = np.sqrt(((tree.points[members] - tree.points[tree.centre[node]]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[node] + 1e-6
        if children:
            spans = sorted((tree.first[c], tree.stop[c]) for c in children)
            assert spans[0][0] == tree.first[node] and spans[-1][1] == tree.stop[node]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_pruning_saves_products():
    draw = np.random.default_rng(5)
    centres = 9 * draw.normal(size=(30, 8))
    points = np.floor(1024 * (centres[draw.integers(0, 30, 4000)] + 0.05 * draw.normal(size=(4000, 8))))
    block, queries = cover_search.Tree(points), cover_search.Tree(points[:512])
    best = cover_search.Best(512, 5)
    ids = np.arange(4000)
    assert cover_search.dual_search(queries, ids[:512], block, ids, best) < 512 * 4000 / 2
