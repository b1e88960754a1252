"""Importance resampling on held-out labels, exact selection, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkjets.llm import importance, near_dups, rule_ledger
from sparkjets.llm.common import keep


@pytest.mark.parametrize("k", [1, 7, 500, 1000])
def test_kth_largest(spark, k):
    draw = np.random.default_rng(k)
    values = [int(v) for v in draw.integers(-(1 << 61), 1 << 61, 900)] + [5] * 100
    df = spark.createDataFrame([(v,) for v in values], "v0 long")
    value, inside = importance.kth_largest(df, "v0", k)
    ordered = sorted(values, reverse=True)
    assert value == ordered[k - 1] and inside == k - sum(v > value for v in values)


def test_exactly_k_are_kept(spark):
    rows = [(i, i * 7, 0.0 if i % 3 else float(i)) for i in range(400)]
    weighted = keep(spark.createDataFrame(rows, "doc_id long, text_hash long, log_weight double"), "w")
    drawn, k = importance.resample(weighted, 100.0)
    assert k == sum(w >= 100 for *_, w in rows) == drawn.where("kept").count()
    least = drawn.where("kept").agg(F.min("key")).first()[0]
    assert drawn.where(~F.col("kept") & (F.col("key") > least)).count() == 0
    assert importance.resample(weighted, 1e9)[0].where("kept").count() == 0


def test_noise_is_gumbel(spark):
    noise = [r[0] for r in spark.range(20000).select(importance.gumbel("id")).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.03 and abs(np.std(noise) - np.pi / 6**0.5) < 0.03


def test_threshold_weighs_errors():
    good, bad = np.array([1.0, 2.0, 3.0, -1.0]), np.array([-5.0, -4.0, 0.0])
    assert -4 < importance.best_threshold(good, bad, cost=5) < -1
    assert 0 < importance.best_threshold(good, bad, cost=0.5) < 1
    assert importance.best_threshold(good, np.array([])) == -np.inf


def test_models_agree_with_a_plain_count(documents):
    rows = [(1, "good words here"), (2, "bad bad words"), (3, None), (None, "no id"), (4, "")]
    df = documents(rows)
    sample = df.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, good int, held int")
    target, raw = importance.count_models(df, sample)
    size = importance.SINGLES + importance.PAIRS
    plain = [np.bincount(importance.buckets(t), minlength=size) for _, t in rows]
    assert np.array_equal(raw, sum(plain)) and np.array_equal(target, plain[0])


def test_labelled_documents_apart(spark):
    """On labels that no part of the fit has seen, nearly all good documents stay and most junk goes."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    model = importance.fit(docs, labels.where(~unseen))
    weighted = keep(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), model.weight().alias("log_weight")), "w")
    drawn, _ = importance.resample(weighted, model.threshold)
    held = drawn.join(labels.where(unseen), "doc_id").toPandas()
    good, junk = held[(held.quality == 1) & (held.toxic == 0)], held[held.quality == 0]
    assert good.kept.mean() > 0.97 and junk.kept.mean() < 0.3


def test_without_labels_everything_stays(spark, documents, odd):
    df = documents(odd)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = importance.fit(df, labels)
    weighted = keep(df.select("doc_id", F.xxhash64("text").alias("text_hash"), model.weight().alias("log_weight")), "w")
    assert importance.resample(weighted, model.threshold)[0].where("kept").count() == len(odd)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    now = docs.withColumn("row", F.lit(1)).withColumn("log_weight", F.lit("x"))
    columns, texts = now.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in now.collect()}
        now = keep(stage(spark, now, data), "stage")
        assert now.columns == columns
        rows = now.collect()
        after = {r.doc_id for r in rows}
        assert len(rows) == len(after) and after <= before
        assert all(r.text == texts[r.doc_id] for r in rows)
        if name == "quality rules":
            passing = rule_ledger.apply_policy(rule_ledger.ledger(docs), rule_ledger.STANDARD).where("kept")
            assert after == {r.doc_id for r in passing.collect()}
        if name == "quality classifier":
            good = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1 AND toxic = 0")
            expected = {r.doc_id for r in good.collect()} & before
            assert len(expected & after) > 0.95 * len(expected)
    assert len(near_dups.components(docs.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))).collect()) == 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, data).collect()
    assert {r.doc_id for r in last} == after


def test_empty_pipeline(spark, documents, data):
    now = documents([])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, data)
    assert now.count() == 0
