"""Nearest-neighbour mutual information against a look at all pairs."""

import numpy as np
import pytest

from sparkjets.operators import information, ordered


def psi(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))


def brute(x, y, k):
    keep = np.array([np.isfinite(v) and (y == c).sum() > 0 for v, c in zip(x, y)])
    x, y = x[keep], y[keep]
    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    terms = []
    for v, c in zip(x, y):
        own = np.sort(np.abs(x[y == c] - v))
        kk = min(k, len(own) - 1)
        r = own[kk]
        inside = (np.abs(x - v) < r).sum() if r > 0 else (x == v).sum()
        terms.append(psi(kk) - psi((y == c).sum()) - psi(inside))
    return max(0.0, psi(len(x)) + np.mean(terms))


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(ordered, "COARSE", 8)
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 5)
    draw = np.random.default_rng(seed)
    y = draw.choice(3, 400, p=[0.8, 0.17, 0.03])
    columns = {
        "shifted": draw.normal(size=400) + y,
        "rounded": np.round(draw.normal(size=400) + 0.5 * y, 1),  # ties within and across classes
        "tenths": 0.1 * draw.integers(-3, 4, 400),
        "hot": np.where(draw.random(400) < 0.4, 1.0, draw.exponential(size=400)),
        "noise": draw.normal(size=400),
    }
    rows = [(*(float(c[i]) for c in columns.values()), int(y[i])) for i in range(400)]
    rows += [(float("nan"),) * 5 + (0,), (None,) * 5 + (1,), (1.0,) * 5 + (None,), (0.5,) * 5 + (9,), (float("inf"),) * 5 + (2,)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", label int")
    found = {r.variable: r.score for r in information.neighbour_information(df, list(columns), "label").collect()}
    for name, x in columns.items():
        assert found[name] == pytest.approx(brute(x, y, 3), abs=1e-9), name


def test_small_classes(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (5.0, 1), (6.0, 1), (7.0, 2)], "x double, label int")
    x, y = np.array([1.0, 2, 5, 6]), np.array([0, 0, 1, 1])
    assert information.neighbour_information(df, ["x"], "label").first().score == pytest.approx(brute(x, y, 3), abs=1e-9)
    assert information.neighbour_information(df.limit(0), ["x"], "label").collect() == []


def test_edges_of_a_radius():
    draw = np.random.default_rng(2)
    x, r = draw.normal(size=5000) * 10.0 ** draw.integers(-5, 6, 5000), np.abs(draw.normal(size=5000))
    low, high = information._edges_of_radius(x, r)
    assert (high - x >= r).all() and (np.nextafter(high, x) - x < r).all()
    assert (x - low >= r).all() and (x - np.nextafter(low, x) < r).all()
