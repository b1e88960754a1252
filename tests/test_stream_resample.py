"""Resampling of a stream: the target is met after warm-up, and a batch done again changes nothing."""

import os

from pyspark.sql import functions as F

from sparkjets.streaming.resample import acceptance, resample_stream

TARGET = [0.5, 0.3, 0.2]


def run(spark, base):
    rows = spark.readStream.schema("id long, bin int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    return resample_stream(rows, "bin", 3, "id", f"{base}/out", f"{base}/state", f"{base}/checkpoint", TARGET)


def rows_of(df):
    return sorted((r.batch, r.id, r.bin) for r in df.collect())


def test_target_and_restart(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(24_000).select("id", F.when(F.col("id") % 10 < 6, 0).when(F.col("id") % 10 < 9, 1).when(F.col("id") % 1000 != 999, 2).cast("int").alias("bin"))
    for part in range(4):
        rows.where(F.floor(F.col("id") / 10) % 4 == part).coalesce(1).write.parquet(f"{base}/in/part{part}")
    kept = rows_of(run(spark, base))
    assert {b for b, _, _ in kept} == {0, 1, 2, 3} and {b for _, _, b in kept} == {0, 1, 2}
    late = [b for batch, _, b in kept if batch]
    for bin_, share in enumerate(TARGET):
        assert abs(late.count(bin_) / len(late) - share) < 5 * (share * (1 - share) / len(late)) ** 0.5
    assert rows_of(run(spark, base)) == kept  # nothing new: nothing changes
    for name in ("3", ".3.crc"):  # the last batch ended before it could say so
        if os.path.exists(f"{base}/checkpoint/commits/{name}"):
            os.remove(f"{base}/checkpoint/commits/{name}")
    assert rows_of(run(spark, base)) == kept


def test_acceptance_of_what_was_seen(spark):
    counts = spark.createDataFrame([(0, 10), (2, 5)], "bin int, n long")
    found = {r.bin: r._accept for r in acceptance(counts, "bin", 3, [0.2, 0.5, 0.3]).collect()}
    assert set(found) == {0, 2} and found[2] == 1.0 and abs(found[0] - 0.02 / 0.06) < 1e-12
    assert acceptance(counts.limit(0), "bin", 3).collect() == []
