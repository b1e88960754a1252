"""Near-duplicate embeddings against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.llm import embedding_dups

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])


def can_link(i, v):
    return i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(np.float32(x)) for x in v) and any(v)


def brute(rows, threshold=0.9):
    vectors = [np.array([float(np.float32(x)) for x in v]) if can_link(i, v) else None for i, v, _ in rows]
    parent = {i: i for i, _, _ in rows if i is not None}
    links = [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(vectors):
        for y in range(x):
            b = vectors[y]
            if a is None or b is None or len(a) != len(b):
                continue
            a1, b1 = a / np.abs(a).max(), b / np.abs(b).max()
            if a1 @ b1 / math.sqrt((a1 @ a1) * (b1 @ b1)) >= threshold:
                links[x] += 1
                links[y] += 1
                p, q = find(rows[x][0]), find(rows[y][0])
                parent[max(p, q)] = min(p, q)
    out = []
    for (i, _, _), a, n in zip(rows, vectors, links):
        root = None if i is None else (find(i) if a is not None else i)
        out.append((i, n, root, i == root))
    return sorted(map(str, out))


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit("x") for n in ("g", "d", "n", "v", "f1", "cell", "own", "links", "dim")})


def run(spark, rows):
    return sorted(map(str, map(tuple, embedding_dups.near_duplicates(frame(spark, rows)).collect())))


def as_rows(points, order=None):
    ids = range(len(points)) if order is None else order
    return [(int(i), [float(np.float32(x)) for x in p], 0) for i, p in zip(ids, points)]


def near_pairs(draw, n, dim, cosine):
    """n pairs of unit vectors without structure, each pair at the given cosine."""
    a = draw.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.normal(size=(n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(embedding_dups, "CELL", 60)
    monkeypatch.setattr(embedding_dups, "BLOCK", 16)


def test_groups_against_all_pairs(spark, small_cells):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(30, 16))
    near = base[draw.integers(0, 30, 200)] + 0.02 * draw.normal(size=(200, 16))  # far above the threshold: certain
    dense = base[0] + 0.03 * draw.normal(size=(150, 16))
    copies = np.repeat(base[1:2], 120, axis=0)
    points = np.concatenate([base, near, dense, copies, 3 * base[:5], draw.normal(size=(100, 16))])
    order = draw.permutation(len(points))
    rows = as_rows(points, order)
    assert run(spark, rows) == brute(rows)


def test_a_chain_is_one_component(spark, small_cells):
    angle = np.arange(0, 3.0, 0.13)  # neighbours at a cosine of 0.9916, the ends far apart
    chain = np.stack([np.cos(angle), np.sin(angle), np.zeros_like(angle)], axis=1)
    rows = as_rows(np.concatenate([chain, -chain[:1] + [[0, 0, 5.0]]]), [50 - i for i in range(len(chain) + 1)])
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [1.0, inf], 1),
        (7, [1.0, None], 1), (None, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (8, [2.0, 4.0], 1), (8, [5.0, -5.0], 1), (9, [4.0, -4.1], 1),
        (10, [1.0, 2.0, 0.0], 1), (11, [3e38, 3e38], 1), (12, [1e-38, 1e-38], 1), (13, [-1.0], 1), (14, [-7.0], 1), (15, [7.0], 1),
        (16, [0.0, 1.0], 2), (17, [3.0, 9.0], 2),
    ]
    assert run(spark, rows) == brute(rows)


def test_no_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, None, 1)]) == [str((0, 0, 0, True))]


def test_at_the_threshold():
    a = np.array([[1.0, 0.0]])
    b = embedding_dups.unit(np.array([[9.0, math.sqrt(19.0)], [0.9 - 1e-7, math.sqrt(0.19)], [0.9 + 1e-7, math.sqrt(0.19)]]))
    assert embedding_dups.linked(a, b, 0.9).tolist()[0][1:] == [False, True]


def test_recall_without_structure(spark, monkeypatch):
    """Pairs at a cosine of just 0.9 among random directions, many cells: the hardest case."""
    monkeypatch.setattr(embedding_dups, "CELL", 100)
    a, b = near_pairs(np.random.default_rng(5), 2000, 64, 0.9001)
    rows = as_rows(np.concatenate([a, b]))
    found = embedding_dups.near_duplicates(frame(spark, rows)).collect()
    recall = sum(r.n_links for r in found) / 4000
    assert 0.99 <= recall <= 1.0
    assert {r.component_id for r in found if not r.kept} <= set(range(2000))


def test_close_vectors_always_meet():
    draw = np.random.default_rng(6)
    a, b = near_pairs(draw, 3000, 24, 1 - embedding_dups.MARGIN**2 / 2 + 1e-9)
    centroids = embedding_dups.unit(draw.normal(size=(80, 24)))
    places = [set() for _ in range(6000)]
    homes = np.empty(6000, int)
    row, cell, own = embedding_dups.cells_of(np.concatenate([a, b]), centroids, embedding_dups.MARGIN)
    for r, c, o in zip(row.tolist(), cell.tolist(), own.tolist()):
        places[r].add(c)
        if o:
            homes[r] = c
    assert all(min(homes[i], homes[i + 3000]) in places[i] & places[i + 3000] for i in range(3000))


def test_forest_spans_every_component():
    draw = np.random.default_rng(9)
    for size, share in ((40, 0.03), (60, 0.01), (30, 0.5)):
        close = draw.random((size, size + 7)) < share
        label = embedding_dups.forest(close, False)
        want = np.arange(2 * size + 7)
        for _ in range(2 * size + 7):
            for i, j in zip(*np.nonzero(close)):
                want[i] = want[size + j] = min(want[i], want[size + j])
        assert label.tolist() == want.tolist()
