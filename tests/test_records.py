"""Segments of hot keys, the table function, mergeable metric states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkjets.operators import metrics, nested, records


def test_segments_of_a_hot_key(spark):
    draw = np.random.default_rng(1)
    rows = [(0, int(i), float(x)) for i, x in enumerate(draw.integers(0, 50, 1000))] + [(k, 0, 1.0) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "key int, id long, x double").repartition(5)
    segments = nested.nest_segments(df, ["key"], "x", {"value": "x", "id": "id"}, ["id"], 64)
    sizes = {(r.key, r.segment): r.n for r in segments.select("key", "segment", F.size("value").alias("n")).collect()}
    assert sizes == {(0, s): min(64, 1000 - 64 * s) for s in range(16)} | {(k, 0): 1 for k in range(1, 9)}
    flat = nested.explode_segments(segments, ["key"], ["value", "id"]).where("key = 0").orderBy("index").collect()
    assert [(r.value, r.id) for r in flat] == sorted((x, i) for k, i, x in rows if k == 0)
    first = nested.first_of_segments(segments, 100, ["value", "id"])
    assert {r.key: r.n for r in nested.segment_totals(first, ["key"], {"n": F.size("value")}).collect()} == {0: 100} | {k: 1 for k in range(1, 9)}
    assert nested.nest_segments(df.limit(0), ["key"], "x", {"value": "x"}).collect() == []


def test_table_function_on_odd_records(spark):
    rows = [(1, [1, 2], ["a"], [[1.0], [2.0, 3.0]]), (2, [], [], []), (3, None, None, None), (4, [5], ["b"], [[]])]
    df = spark.createDataFrame(rows, "id int, x_a array<int>, x_b array<string>, x_c array<array<double>>")
    one = records.unpack_records(df, "x_", 1, "at")
    assert one.columns == ["id", "x_a", "x_b", "x_c", "at"]
    assert sorted(map(tuple, one.collect())) == [(1, 1, "a", [1.0], 0), (1, 2, None, [2.0, 3.0], 1), (4, 5, "b", [], 0)]
    two = records.unpack_records(df.select("id", "x_c"), "x_", 2, "at", ["id"])
    assert sorted(map(tuple, two.collect())) == [(1, 1.0, 0, 0), (1, 2.0, 1, 0), (1, 3.0, 1, 1)]
    assert records.unpack_records(df.select("id"), "x_").columns == ["id"]


def test_states_merge_in_any_order(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = [(float(s), int(y), float(w), int(g)) for s, y, w, g in zip(draw.random(300), draw.integers(0, 2, 300), draw.random(300), draw.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "score double, label int, weight double, g int")
    whole = metrics.all_metrics(df, "score", "label", "weight", ["g"]).orderBy("g").collect()
    parts = df.randomSplit([0.2, 0.5, 0.3], 1)
    for chunk, part in ((2, parts[2]), (0, parts[0]), (1, parts[0]), (1, parts[1])):
        metrics.save_state(metrics.metric_state(part, "score", "label", "weight", ["g"]), str(tmp_path / "state"), chunk)
    merged = metrics.metrics_of_state(metrics.load_state(spark, str(tmp_path / "state"), ["g"]), ["g"]).orderBy("g").collect()
    for a, b in zip(whole, merged):
        assert tuple(a) == pytest.approx(tuple(b), rel=1e-9)
