"""Rejection resampling of a stream, with acceptance from what has come so far.

The counts of every micro-batch per bin are a small table of their own, named by the
batch; the sum over the batches up to now is what a batch computes acceptance from. A
batch that is done again after a failure has the same rows and number, replaces its
counts and its output, and draws the same: nothing counts twice and a restart gives
the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.functions.random import uniform


def acceptance(counts: DataFrame, bin_column: str, n_bins: int, target: Sequence[float] | None = None) -> DataFrame:
    """``bin, _accept`` of the bins seen: (target / count), scaled so that the largest is one."""
    shares = [1.0 / n_bins] * n_bins if target is None else [float(t) for t in target]
    if len(shares) != n_bins:
        raise ValueError("target needs one entry per bin")
    wanted = F.get(F.array(*[F.lit(s) for s in shares]), F.col(bin_column))
    ratios = counts.where(F.col("n") > 0).select(bin_column, (wanted / F.col("n")).alias("r"))
    largest = F.max("r").over(Window.partitionBy())  # over a row per bin
    return ratios.select(bin_column, F.try_divide("r", largest).alias("_accept"))


def resample_stream(
    rows: DataFrame,
    bin_column: str,
    n_bins: int,
    key: str,
    out: str,
    state: str,
    checkpoint: str,
    target: Sequence[float] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Resample all that a stream holds now, batch by batch; returns everything accepted so far, with its ``batch``.

    ``rows`` is a streaming DataFrame whose ``bin_column`` is a number from 0 to ``n_bins`` - 1;
    rows without a bin go. ``out``, ``state`` and ``checkpoint`` are folders all executors reach.
    Early batches know little and follow the target only roughly.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = batch.where(F.col(bin_column).between(0, n_bins - 1))
        known.groupBy(bin_column).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{state}/batch={number}")
        seen = spark.read.parquet(state).where(F.col("batch") <= number)
        counts = seen.groupBy(bin_column).agg(F.sum("n").alias("n"))
        accept = acceptance(counts, bin_column, n_bins, target)  # a row per bin; Spark decides whether to broadcast it
        kept = known.join(accept, bin_column).where(uniform(key, seed=seed) < F.col("_accept")).drop("_accept")
        kept.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.parquet(out)
