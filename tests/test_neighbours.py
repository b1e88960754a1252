"""Neighbours by cells against all distances."""

import numpy as np
import pytest

from sparkjets.operators import neighbours


def distance(p, q):
    square = 0.0
    for a, b in zip(p, q):
        square += (a - b) * (a - b)
    return float(np.sqrt(square))


def brute(jets, k):
    out = []
    for jet, points in jets.items():
        points = [(i, *p) for i, *p in points if all(x is not None and np.isfinite(x) for x in p)]
        for i, *p in points:
            near = sorted((distance(p, q), j) for j, *q in points)
            out += [(jet, i, n, j, d) for n, (d, j) in enumerate(near[: k + 1]) if n]
    return sorted(out)


def run(spark, jets, k, dims):
    rows = [(jet, i, *map(lambda x: None if x is None else float(x), p)) for jet, points in jets.items() for i, *p in points]
    names = "abc"[:dims]
    df = spark.createDataFrame(rows, "jet long, n long, " + ", ".join(f"{c} double" for c in names))
    return sorted(map(tuple, neighbours.nearest_rows(df, ["jet"], "n", k, list(names)).collect()))


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_against_all_distances(spark, dims, monkeypatch):
    for name, value in (("DIRECT", 12), ("BLOCK", 9), ("BATCH", 4)):
        monkeypatch.setattr(neighbours, name, value)
    draw = np.random.default_rng(dims)
    dense = np.concatenate([0.001 * draw.normal(size=(60, dims)), draw.normal(size=(20, dims)), [[50.0] * dims]])
    copies = np.concatenate([np.repeat(draw.normal(size=(1, dims)), 40, axis=0), draw.normal(size=(12, dims))])
    grid = draw.integers(0, 4, (50, dims)).astype(float)  # ties everywhere
    shapes = [dense, copies, grid, np.zeros((30, dims)), draw.normal(size=(12, dims)), draw.normal(size=(2, dims)), draw.normal(size=(1, dims))]
    jets = {j: [(int(i), *map(float, p)) for i, p in zip(draw.permutation(len(s)), s)] for j, s in enumerate(shapes)}
    jets[50] = [(0, *[None] * dims), (1, *[float("nan")] * dims), (2, *[1.0] * dims), (3, *[float("inf")] * dims), (4, *[-0.0] * dims), (5, *[0.0] * dims)]
    assert run(spark, jets, 3, dims) == brute(jets, 3)


def test_jets_of_many_points_need_no_pyramid(spark, monkeypatch):
    """Jets of 600 points went through every level of a pyramid, 36 million points with more disk than there is."""
    monkeypatch.setattr(neighbours, "materialise", lambda *a: pytest.fail("a pyramid was built"))
    draw = np.random.default_rng(6)
    shapes = [draw.normal(size=(600, 2)), draw.integers(0, 9, (530, 2)).astype(float), 1e200 * draw.normal(size=(5, 2))]
    jets = {j: [(int(i), *map(float, p)) for i, p in zip(draw.permutation(len(s)), s)] for j, s in enumerate(shapes)}
    for k in (2, 20):
        assert run(spark, jets, k, 2) == brute(jets, k)


def test_no_points(spark):
    assert run(spark, {}, 3, 2) == []
