"""Running totals and row numbers in a global order, without a single-task sort.

Rows are cut into buckets that follow the order column. Bucket totals form a
small table whose prefix sums give each bucket its offset; inside a bucket an
ordinary window finishes the job. A partition key that holds a third of all
rows is spread over the buckets like any other. Where only a limit or a cut of the
order is asked for, the rows of all but the buckets at the limit stay in place.

Buckets are two-level: coarse ones between quantiles (a ``CASE`` tree over
literals), each cut evenly into fine ones, so their number can follow the size
of the data while the lookup stays a few comparisons and one
division. The edges are literals of the plan: every stage, and every retry of
a task, sees the same buckets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.functions.binning import _edges_passed

COARSE = 64
ROWS_PER_BUCKET = 2_000_000
#: Offsets of so many partitions x buckets are broadcast at most.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Buckets:
    """Inner edges of the coarse buckets, the outer limits, and the even cuts of each coarse bucket."""

    edges: tuple[float, ...]
    low: float
    high: float
    fine: int = 1

    @classmethod
    def uniform(cls, low: float, high: float, coarse: int = COARSE, fine: int = 128) -> "Buckets":
        """For values whose range is known; values outside fall into the end buckets."""
        step = (high - low) / coarse
        return cls(tuple(low + i * step for i in range(1, coarse)), low, high, fine)

    @classmethod
    def from_quantiles(cls, df: DataFrame, order: str, coarse: int = COARSE, fine: int | None = None) -> "Buckets":
        """Edges near the quantiles of a column. Runs one aggregate job that returns ``coarse`` numbers.

        The digests are merged in groups of partitions first, so that no single
        task receives one digest per input split; the edges only balance the
        buckets and need not be exact.
        """
        levels = [i / coarse for i in range(1, coarse)]
        x = F.col(order).cast("double")
        parts = (
            df.select(x.alias("x"), (F.spark_partition_id() % 512).alias("g"))
            .groupBy("g")
            .agg(
                F.percentile_approx("x", levels, 1000).alias("q"),
                F.min("x").alias("lo"),
                F.max("x").alias("hi"),
                F.count("x").alias("n"),
            )
        )
        row = parts.select("lo", "hi", F.when(F.col("n") > 0, F.col("n")).alias("n"), "q").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.flatten(F.collect_list("q")).alias("q")
        )
        row = row.select("lo", "hi", "n", F.sort_array("q").alias("q")).collect()[0]  # at most 512 * coarse numbers
        if not row.n:
            return cls((), 0.0, 1.0, 1)
        values = row.q
        edges = sorted({values[len(values) * i // coarse] for i in range(1, coarse)})
        if fine is None:
            fine = max(1, math.ceil(row.n / ROWS_PER_BUCKET / coarse))
        return cls(tuple(edges), row.lo, row.hi, fine)

    @property
    def count(self) -> int:
        return (len(self.edges) + 1) * self.fine

    @property
    def is_uniform(self) -> bool:
        return self == Buckets.uniform(self.low, self.high, len(self.edges) + 1, self.fine)

    def column(self, x: Column) -> Column:
        """The bucket number of ``x`` as one expression, for plans that choose among several bucketings."""
        if self.is_uniform:
            return _cell(x, F.lit(self.low), F.lit(self.high - self.low), (len(self.edges) + 1) * self.fine)
        coarse = _edges_passed(x, self.edges, inclusive=True)
        if self.fine == 1:
            return F.coalesce(coarse, F.lit(0))
        borders = [self.low, *self.edges, self.high]
        start = F.get(F.array(*[F.lit(float(b)) for b in borders[:-1]]), coarse)
        width = F.get(F.array(*[F.lit(float(b - a)) for a, b in zip(borders, borders[1:])]), coarse)
        return coarse * self.fine + _cell(x, start, width, self.fine)

    def add(self, df: DataFrame, order: str, out: str) -> DataFrame:
        """Add the bucket number: never decreasing in ``order``, never NULL."""
        x = F.col(order).cast("double")
        if self.is_uniform:
            count = (len(self.edges) + 1) * self.fine
            return df.withColumn(out, _cell(x, F.lit(self.low), F.lit(self.high - self.low), count))
        # staged, so that the search and the cast appear once in the generated code
        df = df.withColumn("_x", x).withColumn("_coarse", _edges_passed(F.col("_x"), self.edges, inclusive=True))
        if self.fine == 1:
            bucket = F.coalesce("_coarse", F.lit(0))
        else:
            borders = [self.low, *self.edges, self.high]
            start = F.get(F.array(*[F.lit(float(b)) for b in borders[:-1]]), F.col("_coarse"))
            width = F.get(F.array(*[F.lit(float(b - a)) for a, b in zip(borders, borders[1:])]), F.col("_coarse"))
            bucket = F.col("_coarse") * self.fine + _cell(F.col("_x"), start, width, self.fine)
        return df.withColumn(out, bucket).drop("_x", "_coarse")


def _cell(x: Column, start: Column, width: Column, count: int) -> Column:
    """Which of ``count`` even cells holds ``x``, the end cells taking what lies outside."""
    share = F.coalesce(F.try_divide(x - start, width), F.lit(0.0))
    inside = F.least(F.greatest(share * float(count), F.lit(0.0)), F.lit(float(count - 1)))
    return inside.cast("int")


# A 64-bit hash is spread evenly, so its buckets need no look at the data.
HASH_BUCKETS = Buckets.uniform(-(2.0**63), 2.0**63, COARSE, 128)


def _offsets(rows: DataFrame, partition: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per bucket: the sums of all earlier buckets (``_o``) and of its own rows (``_s``)."""
    before = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy(*partition, "_bucket")
        .agg(*[F.sum(v).alias(f"_s{v}") for v in values])
        .select(
            *[F.col(p).alias(f"_p_{p}") for p in partition],
            F.col("_bucket").alias("_b"),
            *[F.col(f"_s{v}") for v in values],
            *[F.coalesce(F.sum(f"_s{v}").over(before), F.lit(0)).alias(f"_o{v}") for v in values],
        )
    )


def _few(partition: Sequence[str], known: int, buckets: Buckets) -> bool:
    """Whether a table of partitions x buckets is small enough to send to every task; both are known here."""
    partitions = known if partition else 1
    return 0 < partitions * buckets.count <= BROADCAST_ROWS


def _same_group(partition: Sequence[str]) -> Column:
    condition = F.col("_bucket") == F.col("_b")
    for p in partition:
        condition &= F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    return condition


def _inside(partition: Sequence[str], order: str, tie_breakers: Sequence[str]):
    return (
        Window.partitionBy(*partition, "_bucket")
        .orderBy(order, *tie_breakers)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def totals_in_buckets(
    rows: DataFrame, order: str, values: Sequence[str], partition: Sequence[str], tie_breakers: Sequence[str]
) -> DataFrame:
    """``rows`` (with their ``_bucket``) and the inclusive running sum ``_t<value>`` of every value.

    Offsets join on the window's own keys, whatever the number of buckets and partitions.
    """
    joined = rows.join(_offsets(rows, partition, values), _same_group(partition))
    inside = _inside(partition, order, tie_breakers)
    return joined.select(*rows.columns, *[(F.sum(v).over(inside) + F.col(f"_o{v}")).alias(f"_t{v}") for v in values])


def running_totals(
    df: DataFrame,
    order: str,
    totals: Mapping[str, Column],
    partition: Sequence[str] = (),
    tie_breakers: Sequence[str] = (),
    buckets: Buckets | None = None,
    known_partitions: int = 0,
) -> DataFrame:
    """Add inclusive running sums in the order of ``order`` (numeric), then ``tie_breakers``.

    ``order`` may repeat, but rows that share one value share a task: aggregate
    by it first, or use a nearly unique column. Rows with a NULL partition key
    are a partition of their own.

    ``known_partitions``: how many there are, where a binning or a list says it. If these
    times the buckets stay within ``BROADCAST_ROWS`` the offsets are broadcast. Otherwise
    they join on the window's own keys, so the rows are shuffled once either way.
    """
    partition = list(partition)
    buckets = buckets or Buckets.from_quantiles(df, order)
    values = {f"_v_{name}": value for name, value in totals.items()}
    rows = buckets.add(df, order, "_bucket").withColumns(values)
    offsets = _offsets(rows, partition, list(values))
    small = _few(partition, known_partitions, buckets)
    joined = rows.join(F.broadcast(offsets) if small else offsets, _same_group(partition))
    inside = _inside(partition, order, tie_breakers)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(f"_v_{name}").over(inside) + F.col(f"_o_v_{name}")).alias(name) for name in totals],
    )


def number_rows(
    df: DataFrame,
    order: str,
    out: str = "row_number",
    partition: Sequence[str] = (),
    tie_breakers: Sequence[str] = (),
    buckets: Buckets | None = None,
    known_partitions: int = 0,
) -> DataFrame:
    """One-based row number in a global (or per-partition) order."""
    one = {out: F.lit(1).cast("long")}
    return running_totals(df, order, one, partition, tie_breakers, buckets, known_partitions)


def cut_order(
    df: DataFrame,
    order: str,
    cuts: Sequence[Column],
    out: str,
    partition: Sequence[str] = (),
    tie_breakers: Sequence[str] = (),
    buckets: Buckets | None = None,
    known_partitions: int = 0,
) -> DataFrame:
    """Add the segment (0, 1, ...) of every row when its order is cut after ``cuts`` rows.

    ``cuts`` are rising row counts, the same or per partition. A bucket whose
    rows all fall between two cuts needs no ranking: only the buckets that a cut
    runs through are shuffled and sorted, which is one bucket per cut and
    partition. With few ``known_partitions`` (see :func:`running_totals`) the bounds
    are broadcast and the other rows stay in place.

    ``df`` is read for the bucket totals and for both branches of the result, so
    it must give the same rows every time, and one that is costly to compute is
    better written out first (``sources.io.materialise``).
    """
    partition = list(partition)
    buckets = buckets or Buckets.from_quantiles(df, order)
    rows = buckets.add(df, order, "_bucket").withColumn("_v", F.lit(1).cast("long"))
    bounds = _offsets(rows, partition, ["_v"])
    for p in partition:  # so that a cut may refer to its partition
        bounds = bounds.withColumn(p, F.col(f"_p_{p}"))
    first, last = F.col("_o_v"), F.col("_o_v") + F.col("_s_v")
    split_here, segment = F.lit(False), F.lit(0)
    for cut in cuts:
        split_here = split_here | ((first < cut) & (last > cut))
        segment = segment + (first >= cut).cast("int")
    bounds = bounds.withColumns({"_split": split_here, "_segment": segment})
    bounds = bounds.withColumns({f"_cut{i}": cut for i, cut in enumerate(cuts)}).drop(*partition, "_s_v")
    small = _few(partition, known_partitions, buckets)
    joined = rows.join(F.broadcast(bounds) if small else bounds, _same_group(partition))
    whole = joined.where(~F.col("_split")).select(*df.columns, F.col("_segment").alias(out))
    place = F.sum("_v").over(_inside(partition, order, tie_breakers)) + F.col("_o_v")
    ranked = joined.where("_split").withColumn("_place", place)
    exact = F.lit(0)
    for i in range(len(cuts)):
        exact = exact + (F.col("_place") > F.col(f"_cut{i}")).cast("int")
    return whole.unionByName(ranked.select(*df.columns, exact.alias(out)))


def keep_first(
    df: DataFrame,
    order: str,
    limit: Column,
    partition: Sequence[str] = (),
    tie_breakers: Sequence[str] = (),
    buckets: Buckets | None = None,
    known_partitions: int = 0,
) -> DataFrame:
    """The first ``limit`` rows (of every partition). Only the bucket at the limit is shuffled."""
    cut = cut_order(df, order, [limit], "_part", partition, tie_breakers, buckets, known_partitions)
    return cut.where(F.col("_part") == 0).drop("_part")
