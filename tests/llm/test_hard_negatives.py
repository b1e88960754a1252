"""Hard negatives of the inverted multi-index against all products."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.llm import multi_index

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])
LONGEST = (1 << 63) - 1


def brute(rows, positives, negatives):
    vectors = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(np.float32(x)) for x in v):
            continue
        vectors.append((i, label, [math.floor(Fraction(float(np.float32(x))) * 256) for x in v]))
    out = []
    for i, label, q in vectors:
        if i % 100:
            continue
        scored = []
        for j, other, w in vectors:
            if j != i and len(w) == len(q):
                score = sum(a * b for a, b in zip(q, w))
                scored.append((-min(max(score, -LONGEST - 1), LONGEST), j, other == label))
        scored.sort()
        for p, (ps, pid, _) in enumerate([s for s in scored if s[2]][:positives], 1):
            window = [s for s in scored if not s[2] and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:negatives]
            out += [(i, pid, p, r, j, -ps, -s) for r, (s, j, _) in enumerate(window, 1)]
    return sorted(out)


def run(spark, rows, positives=5, negatives=10):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("score", "dim", "rid", "slot", "cells", "v")})
    found = multi_index.hard_negatives(df, F.col("id") % 100 == 0, positives, negatives)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_against_all_products(spark, kind, monkeypatch):
    for name, value in (("BLOCK", 90), ("BATCH", 2), ("FIRST", 40), ("CELL", 4)):
        monkeypatch.setattr(multi_index, name, value)
    draw = np.random.default_rng(4)
    if kind == "clusters":
        points = draw.normal(size=(12, 8))[draw.integers(0, 12, 900)] + 0.15 * draw.normal(size=(900, 8))
    else:
        points = draw.normal(size=(900, 8))
    if kind == "copies":  # a third of all rows is one vector
        points[100:400] = points[0]
    rows = [(i, [float(np.float32(x)) for x in p], int(draw.integers(0, 4))) for i, p in enumerate(points)]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (100, [0.5, 1.0], 1), (100, [0.25, 9.0], 2), (200, None, 1), (300, [1.0, None], 1),
        (400, [nan, 1.0], 1), (500, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (600, [1.0, 1.0], None), (3, [0.5, 0.0], 2),
        (4, [1.0, 1.0], 2), (4, [1.0, 1.0], 2), (5, [1.0, 2.0], 1), (700, [1.0, 2.0, 3.0], 1), (7, [4.0, 5.0, 6.0], 1),
        (8, [1.0, 1.0, 1.0], 3), (900, [1.0], 1), (9, [1.0], 1), (10, [0.5], 2), (1000, [], 1), (11, [], 2), (12, [-1.0, -1.0], 1),
    ]
    assert run(spark, rows) == brute(rows, 5, 10)
    large = [(0, [2.0**40, 3.0], 1), (1, [2.0**10, 1.0], 1), (2, [512.0, 2.0**20], 2), (3, [511.0, 7.0], 2), (4, [3e38, 1.0], 2), (5, [3e38, 2.0], 1)]
    assert run(spark, large) == brute(large, 5, 10)


def test_nothing_to_mine(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, None, 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []  # no other label
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor


def test_tables_between_rounds_do_not_list_the_cells_of_every_anchor(spark, monkeypatch):
    """Every row is an anchor and no cell can be excluded: 700 anchors, some hundreds of cells."""
    for name, value in (("BLOCK", 90), ("BATCH", 16), ("FIRST", 40), ("CELL", 1), ("HELD", 1)):
        monkeypatch.setattr(multi_index, name, value, raising=False)
    entries, keep = [], multi_index.keep

    def measured(df, name, *more):
        out = keep(df, name, *more)
        if name == "visits":
            lists = [f.name for f in out.schema if isinstance(f.dataType, T.ArrayType)]
            entries.append(out.select(F.sum(sum((F.size(c) for c in lists), F.lit(0)))).first()[0])
        return out

    monkeypatch.setattr(multi_index, "keep", measured)
    draw = np.random.default_rng(9)
    rows = [(100 * i, [float(np.float32(x)) for x in p], int(draw.integers(0, 4))) for i, p in enumerate(draw.normal(size=(700, 8)))]
    assert run(spark, rows, 3, 4) == brute(rows, 3, 4)
    assert max(entries) < 5 * len(rows), entries


def test_windows_keep_the_best_rows_over_all_blocks(monkeypatch):
    monkeypatch.setattr(multi_index, "HANDED", 30)
    draw = np.random.default_rng(10)
    points = np.floor(256 * draw.normal(size=(500, 6)))
    points[40:60] = points[7]  # ties
    points[2] = 0  # ties with every row
    index, (first, second) = made(points, 5)
    ids, labels, codes = np.arange(500), draw.integers(0, 3, 500), first * 5 + second
    asks = [
        {"rid": 900 + r, "id": i, "label": int(labels[i]), "reach": -math.inf}
        | {"slots": [{"slot": s, "low": -50000, "high": h} for s, h in enumerate(highs)]}
        for r, (i, highs) in enumerate([(0, (10**6,)), (1, (200000, 40000)), (2, (0, 10**5, -60000)), (7, (10**6,))])
    ]
    windows = multi_index.Windows(asks, points[[0, 1, 2, 7]], 4)
    for start in range(490, -1, -70):
        part = slice(start, start + 70)
        windows.meet(index, codes[part], ids[part], labels[part], points[part], False)
    found = sorted(tuple(r.values()) for batch in windows.rows() for r in batch.to_pylist())
    wanted = []
    for a in asks:
        scores = (points @ points[a["id"]]).astype(int)
        for s in a["slots"]:
            fits = [i for i in ids if labels[i] != a["label"] and s["low"] <= scores[i] <= s["high"]]
            wanted += [(a["rid"], s["slot"], int(i), int(scores[i])) for i in sorted(fits, key=lambda i: (-scores[i], i))[:4]]
    assert found == sorted(wanted)


def made(points, k):
    half = points.shape[1] // 2
    index = multi_index.Index([multi_index.codebook(p, k) for p in (points[:, :half], points[:, half:])])
    codes = [multi_index.nearest(p, w) for p, w in zip((points[:, :half], points[:, half:]), index.words)]
    for h, part in enumerate((points[:, :half], points[:, half:])):
        away = np.sqrt(((part - index.words[h][codes[h]]) ** 2).sum(axis=1))
        np.maximum.at(index.radii[h], codes[h], away)
    np.add.at(index.size, tuple(codes), 1)
    index.bundle[:] = 0
    return index, codes


def test_cells_come_in_order_and_hold_their_bounds():
    draw = np.random.default_rng(6)
    points = np.floor(256 * draw.normal(size=(2000, 6)))
    index, (first, second) = made(points, 12)
    for query in points[:5]:
        walk = list(index.cells(query))
        assert sorted((i, j) for _, i, j in walk) == sorted(set(zip(first.tolist(), second.tolist())))
        assert all(a[0] >= b[0] for a, b in zip(walk, walk[1:]))
        score = points @ query
        for bound, i, j in walk:
            assert score[(first == i) & (second == j)].max() <= bound


def test_certified_windows_stop_early():
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(20, 8))
    points = np.floor(256 * (centres[draw.integers(0, 20, 5000)] + 0.03 * draw.normal(size=(5000, 8))))
    index, codes = made(points, 24)
    fifth = np.sort(points @ points[0])[-6]
    seen = sum(index.size[i, j] for bound, i, j in index.cells(points[0]) if bound >= fifth)
    assert seen < 2500


def test_visits_resume_where_they_stopped():
    points = np.floor(256 * np.random.default_rng(8).normal(size=(600, 4)))
    index, _ = made(points, 8)
    whole = [i * 8 + j for _, i, j in index.cells(points[3])]
    taken, done, bound, parts = {}, 0, 0.0, []
    while bound > -math.inf:
        taken, done, bound = multi_index.visits(index, points[3], done, 100)
        parts += [c for own in taken.values() for c in own]
    assert parts == whole
