import random
import re

import pytest
from pyspark.sql import functions as F

from sparkjets.operators import resample, split
from sparkjets.operators.ordered import Buckets, keep_first, number_rows, running_totals


def rows(n=5000, seed=3):
    """A third of all rows shares one bin; values repeat a lot."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = rng.random() < 1 / 3
        out.append((i, 0 if hot else rng.randrange(1, 6), float(rng.randrange(50)), rng.randrange(1, 9)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "id long, bin int, x double, w int").repartition(7)


@pytest.mark.parametrize("partition", [[], ["bin"]])
@pytest.mark.parametrize("coarse, fine", [(4, 1), (16, 7), (128, None)])
@pytest.mark.parametrize("few", [True, False])
def test_running_totals_against_brute_force(df, partition, coarse, fine, few):
    buckets = Buckets.from_quantiles(df, "x", coarse, fine)
    found = running_totals(
        df, "x", {"s": F.col("w"), "n": F.lit(1)}, partition, ["id"], buckets, known_partitions=5 if few else 0
    )
    state, expected = {}, {}
    for i, b, x, w in sorted(rows(), key=lambda r: (r[2], r[0])):
        key = b if partition else None
        s, n = state.get(key, (0, 0))
        state[key] = (s + w, n + 1)
        expected[i] = state[key]
    assert {r.id: (r.s, r.n) for r in found.collect()} == expected


def test_number_rows_spreads_a_hot_bin(df):
    numbered = number_rows(df, "id", "nth", ["bin"], known_partitions=5)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(bin#\d+, _bucket#\d+", plan)  # the window is keyed by the bucket too
    by_bin = {}
    for r in numbered.orderBy("id").collect():
        by_bin.setdefault(r.bin, []).append(r.nth)
    assert all(v == list(range(1, len(v) + 1)) for v in by_bin.values())


def test_min_count_keeps_the_first_rows(df):
    def expected(limit):
        seen, kept = {}, set()
        for i, b, *_ in sorted(rows()):
            seen[b] = seen.get(b, 0) + 1
            if seen[b] <= limit:
                kept.add(i)
        return kept

    counts = {}
    for _, b, *_ in rows():
        counts[b] = counts.get(b, 0) + 1
    smallest = min(counts.values())
    classic = resample.keep_min_count(df, "bin", 6, "id")
    assert {r.id for r in classic.collect()} == expected(smallest - 1)
    inclusive = resample.keep_min_count(df, "bin", 6, "id", inclusive=True)
    assert {r.id for r in inclusive.collect()} == expected(smallest)
    with pytest.raises(Exception, match="a bin is empty"):
        resample.keep_min_count(df, "bin", 7, "id").count()


def test_contiguous_split(df):
    tagged = split.split_contiguous(df, {"train": 0.5, "dev": 0.3, "test": 0.2}, "id")
    parts = {}
    for r in tagged.collect():
        parts.setdefault(r.split, []).append(r.id)
    assert sorted(parts["train"]) == list(range(2500))
    assert sorted(parts["dev"]) == list(range(2500, 4000))
    assert sorted(parts["test"]) == list(range(4000, 5000))
    with pytest.raises(ValueError):
        split.split_contiguous(df, {"a": 0.5, "b": 0.4}, "id")


def test_random_results_do_not_depend_on_partitions(spark, df):
    def run(n):
        some = df.repartition(n)
        tagged = split.split_random(some, {"a": 0.5, "b": 0.5}, "id", seed=5)
        kept = resample.rejection_resample(some, "bin", 6, "id", seed=5)
        return {r.id: r.split for r in tagged.collect()}, {r.id for r in kept.collect()}

    assert run(2) == run(13)


def test_batches(df):
    out = split.batches(df, 300, "id", ["id", "x"], take=1000).orderBy("batch").collect()
    assert [r.size for r in out] == [300, 300, 300, 100]
    assert [i for r in out for i in r.id] == list(range(1000))


def test_values_outside_the_bucket_range(spark):
    df = spark.createDataFrame([(float(x),) for x in (-9, -1, 0, 0.5, 1, 7, 9)], "x double")
    found = running_totals(df, "x", {"n": F.lit(1)}, buckets=Buckets.uniform(0.0, 1.0, 4, 3))
    assert [r.n for r in found.orderBy("x").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_empty_input(spark):
    df = spark.createDataFrame([], "x double")
    assert number_rows(df, "x").count() == 0


def test_only_buckets_at_the_limit_are_shuffled(df):
    kept = resample.keep_min_count(df, "bin", 6, "id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    whole, at_limit = plan[plan.index("Union") :].split("Window [", 1)
    assert "BroadcastHashJoin [_bucket" in whole
    before_join = whole[: whole.index("BroadcastHashJoin [_bucket")]
    assert "Exchange hashpartitioning(bin" not in before_join  # whole buckets pass without a shuffle


@pytest.mark.parametrize("coarse, fine", [(4, 1), (16, 7), (64, 128)])
def test_keep_first_against_brute_force(df, coarse, fine):
    buckets = Buckets.from_quantiles(df, "x", coarse, fine)
    for limit in (0, 1, 137, 10_000):
        kept = keep_first(df, "x", F.lit(limit), ["bin"], ["id"], buckets)
        seen, expected = {}, set()
        for i, b, *_ in sorted(rows(), key=lambda r: (r[2], r[0])):
            seen[b] = seen.get(b, 0) + 1
            if seen[b] <= limit:
                expected.add(i)
        assert {r.id for r in kept.collect()} == expected


def test_large_take(df, monkeypatch):
    assert sorted(r.id for r in split.take_first(df, 1234, ["id"]).collect()) == list(range(1234))
