import math
import random

import pytest
from pyspark.sql import functions as F

from sparkjets.functions.binning import Binning
from sparkjets.operators import metrics


def brute_scan(rows, n=200):
    out = []
    pos = sum(w for y, s, w in rows if y == 1)
    neg = sum(w for y, s, w in rows if y == 0)
    for i in range(n):
        t = i / (n - 1)
        out.append(
            (
                t,
                sum(w for y, s, w in rows if y == 1 and s > t) / pos,
                sum(w for y, s, w in rows if y == 0 and s <= t) / neg,
            )
        )
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(int(rng.random() < 0.4), rng.choice([rng.random(), rng.randrange(200) / 199]), rng.randrange(1, 5)) for _ in range(1500)]
    return out + [(1, 0.0, 1), (0, 1.0, 2), (1, 1.0, 1), (0, 0.0, 3)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(y, s, float(w)) for y, s, w in rows], "label int, score double, weight double")


def test_threshold_table(df, rows):
    found = metrics.threshold_table(df, "score", "label", "weight").orderBy("idx").collect()
    for row, (t, tpr, tnr) in zip(found, brute_scan(rows), strict=True):
        assert (row.threshold, row.tpr, row.tnr) == (t, tpr, tnr)


def test_first_threshold_wins_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, score double")
    row = metrics.working_point(df, "score", "label", 1.0).first()
    assert row.threshold == 0.0 and row.tpr == 1.0


def test_all_metrics(df, rows):
    found = metrics.all_metrics(df, "score", "label", "weight", threshold=0.4).first()
    pos = sum(w for y, s, w in rows if y == 1)
    neg = sum(w for y, s, w in rows if y == 0)
    quark = sum(w for y, s, w in rows if y == 1 and s > 0.4) / pos
    gluon = sum(w for y, s, w in rows if y == 0 and s <= 0.4) / neg
    accuracy = sum(w for y, s, w in rows if (s > 0.5) == (y == 1)) / (pos + neg)
    assert math.isclose(found.quark_efficiency, quark) and math.isclose(found.gluon_efficiency, gluon)
    assert math.isclose(found.gluon_rejection, 1 / (1 - gluon)) and math.isclose(found.binary_accuracy, accuracy)
    scan = brute_scan(rows)
    best = min(range(200), key=lambda i: ((scan[i][1] - 0.5) ** 2, i))
    assert math.isclose(found.threshold_at_fixed_quark_50wp, scan[best][0])
    assert math.isclose(found.gluon_rejection_at_quark_50wp, 1 / (1 - scan[best][2]))
    ends = [(1.0, 1.0)] + [(1 - tnr, tpr) for _, tpr, tnr in scan[1:-1]] + [(0.0, 0.0)]
    area = sum((a[0] - b[0]) * (a[1] + b[1]) / 2 for a, b in zip(ends, ends[1:]))
    assert math.isclose(found.auc, area)
    assert found.num_events == len(rows)


def test_exact_auc_and_roc(df, rows):
    pairs = sum(a[2] * b[2] * (1 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0) for a in rows if a[0] for b in rows if not b[0])
    pos = sum(w for y, s, w in rows if y == 1)
    neg = sum(w for y, s, w in rows if y == 0)
    assert math.isclose(metrics.auc(df, "score", "label", "weight").first().auc, pairs / (pos * neg))
    roc = metrics.roc_points(df, "score", "label", "weight").orderBy(F.col("threshold").desc()).collect()
    assert len(roc) == len({s for _, s, _ in rows})
    middle = roc[len(roc) // 2]
    assert math.isclose(middle.tpr, sum(w for y, s, w in rows if y == 1 and s >= middle.threshold) / pos)
    assert math.isclose(roc[-1].fpr, 1.0)


def test_binned_example(spark):
    df = spark.createDataFrame(
        [(i % 2, (i + 1) / 10, i + 1) for i in range(8)], "label int, score double, jets_pt int"
    )
    out = metrics.binned_metrics(df, Binning("jets_pt", [2, 5, 7, 9.5]), "score", "label").orderBy("bin").collect()
    assert [r.num_events for r in out] == [3, 2, 1]
    assert out[0].binary_accuracy == pytest.approx(2 / 3)
    empty = metrics.binned_metrics(df, Binning("jets_pt", [2, 5, 20, 30]), "score", "label").where("bin = 2").first()
    assert empty.num_events is None and empty.auc is None and empty.bin_label == "(20.0, 30.0]"


def test_missing_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2)], "label int, score double")
    row = metrics.all_metrics(df, "score", "label").first()
    assert row.gluon_efficiency is None and row.auc is None and row.quark_efficiency == 0.5


def test_effective_tagging_efficiency(spark):
    df = spark.createDataFrame([(1, 0.99), (0, 0.99), (1, 0.52), (0, 0.5)], "label int, score double")
    # dilutions .98 .98 .04 0: the last one is not counted; one of two is wrong in the top bin
    value = metrics.effective_tagging_efficiency(df, "score", "label").first()[0]
    assert value == pytest.approx((2 * 0.0 + 1 * 1.0) / 3)
    with pytest.raises(ValueError):
        metrics.effective_tagging_efficiency(df, "score", "label", [0, 2])


def test_scan_does_not_multiply_rows(df):
    plan = metrics.threshold_table(df, "score", "label", "weight")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Generate explode") :]
    assert below.count("HashAggregate") >= 2  # rows are aggregated to buckets below the explode
