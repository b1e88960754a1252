"""Mutual information of numbers with a class, by nearest neighbours in one dimension.

The estimate of Ross (2014): a point's radius is the distance to its k-th neighbour of
the same class; what counts is how many points of any class lie strictly inside it.
Neither step looks at pairs. Equal values are counted first. Values are cut into ordered
buckets; a bucket learns the k values before and after it, per class, from the border
rows of the others, a table of 2k rows per bucket. How many points lie inside a radius is
the difference of two running counts over all values, taken bucket by bucket as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.operators.ordered import Buckets, totals_in_buckets
from sparkjets.sources.io import materialise, shared_folder


def digamma(x: Column) -> Column:
    """Digamma of a number of 1 or more, right to about 1e-11: six steps up, then the asymptotic series."""
    x = x.cast("double")
    up = x + F.lit(6.0)
    series = F.log(up) - F.lit(0.5) / up - F.lit(1.0) / (up * up * 12.0)
    series = series + F.lit(1.0) / (up * up * up * up * 120.0) - F.lit(1.0) / (up * up * up * up * up * up * 252.0)
    for step in range(6):
        series = series - F.lit(1.0) / (x + float(step))
    return series


_LARGEST = np.int64((1 << 63) - 1)


def _order(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order, neighbours one apart."""
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ _LARGEST, bits)


def _number(order: np.ndarray) -> np.ndarray:
    return np.where(order < 0, order ^ _LARGEST, order).view(np.float64)


def _above(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The smallest number above ``x`` whose difference from it, as rounded, is ``r`` or more."""
    inside, outside = _order(x + 0.0), _order(np.where(r > 0, x + 2 * r, np.nextafter(x, np.inf)))
    for _ in range(64):
        middle = (inside >> 1) + (outside >> 1) + (inside & outside & 1)
        far = (_number(middle) - x >= r) & (middle > inside)
        outside = np.where(far, middle, outside)
        inside = np.where(far, inside, middle)
    return _number(outside)


def _edges_of_radius(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest number below and smallest above ``x`` that are ``r`` away or more, as differences are rounded.

    A radius of zero holds the value itself.
    """
    with np.errstate(over="ignore"):
        return -_above(-x, r), _above(x, r)


def _with_halos(values: DataFrame, k: int) -> DataFrame:
    """``values`` with the k values before and after each bucket of a class, marked as ``own = false``."""
    group = ["variable", "y"]
    inside = Window.partitionBy(*group, "bucket")
    ranked = values.withColumns({
        "_first": F.row_number().over(inside.orderBy("x")),
        "_last": F.row_number().over(inside.orderBy(F.desc("x"))),
    })
    border = ranked.where((F.col("_first") <= k) | (F.col("_last") <= k))
    item = F.collect_list(F.struct("x", "n"))
    along = Window.partitionBy(*group).orderBy("x")  # 2k rows of every bucket
    near = border.withColumns({
        "_before": F.when(F.col("_first") == 1, item.over(along.rowsBetween(-k, -1))),
        "_after": F.when(F.col("_last") == 1, item.over(along.rowsBetween(1, k))),
    })
    halo = near.select(*group, "bucket", F.explode(F.concat(F.coalesce("_before", F.array().cast("array<struct<x:double,n:bigint>>")), F.coalesce("_after", F.array().cast("array<struct<x:double,n:bigint>>")))).alias("h"))
    guests = halo.select(*group, "bucket", F.col("h.x").alias("x"), F.col("h.n").alias("n"), F.lit(False).alias("own"))
    return values.select(*group, "bucket", "x", "n", F.lit(True).alias("own")).unionByName(guests)


def neighbour_radius(values: DataFrame, k: int) -> DataFrame:
    """``variable, y, x, n, radius, k``: the distance to the k-th neighbour of the same class.

    ``values`` are distinct ``variable, y, x`` with their counts ``n``, the size of the
    class ``size`` (above one) and the ``bucket`` of x. A class with fewer others than k takes them all.
    """
    sizes = values.groupBy("variable", "y").agg(F.first("size").alias("size"))
    rows = _with_halos(values, k)
    around = Window.partitionBy("variable", "y", "bucket").orderBy("x").rowsBetween(-k, k)
    seen = rows.withColumn("near", F.collect_list(F.struct("x", "n")).over(around)).where("own")
    seen = seen.join(F.broadcast(sizes), ["variable", "y"])  # a row per variable and class
    wanted = F.least(F.lit(k), F.col("size") - 1).cast("long")
    apart = F.sort_array(F.transform("near", lambda o: F.struct(F.abs(o["x"] - F.col("x")).alias("d"), (o["n"] - (o["x"] == F.col("x")).cast("long")).alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
    walked = F.aggregate(
        apart, start,
        lambda acc, o: F.struct(
            (acc["n"] + o["n"]).alias("n"),
            F.when(acc["d"].isNull() & (acc["n"] + o["n"] >= F.col("k")), o["d"]).otherwise(acc["d"]).alias("d"),
        ),
    )
    return seen.withColumn("k", wanted).select("variable", "y", "x", "n", walked["d"].alias("radius"), "k", "size")


def _probes(points: DataFrame) -> DataFrame:
    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = _edges_of_radius(batch["x"].to_numpy(), batch["radius"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], [*batch.schema.names, "low", "high"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(bounds, f"{kinds}, low double, high double")


def neighbour_information(df: DataFrame, columns: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """``variable, score`` (nats, 0 at least) of every numeric column with the class ``label``.

    Rows with a NULL class, and per column those whose value is NULL, NaN or infinite, take
    no part; nor does the only row of a class. Equal values are neighbours at distance zero.
    """
    slots = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(slots).alias("s")).select("s.variable", "y", "s.x")
    finite = long.where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    counted = finite.groupBy("variable", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("variable", "y").agg(F.sum("n").alias("size"))
    values = counted.join(F.broadcast(sizes.where("size > 1")), ["variable", "y"])  # a row per variable and class
    buckets = {c: Buckets.from_quantiles(finite.where(F.col("variable") == c), "x") for c in columns}

    def bucket(x: str) -> Column:  # a column's buckets follow its own values
        return F.coalesce(*[F.when(F.col("variable") == c, b.column(F.col(x))) for c, b in buckets.items()])

    spark = df.sparkSession
    probes = _probes(neighbour_radius(values.withColumn("bucket", bucket("x")), k))
    probes = materialise(probes, shared_folder(spark))  # read for the totals of buckets and for the counts inside them
    keep = ["variable", "y", "x", "n", "k", "size"]
    nothing = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in keep[1:]]
    events = probes.groupBy("variable", "x").agg(F.sum("n").alias("_w")).select(
        "variable", F.col("x").alias("at"), F.lit(1).alias("kind"), "_w", *nothing
    )
    for name, kind in (("high", 0), ("low", 2)):  # before the values equal to it, and after them
        bounds = probes.select("variable", F.col(name).alias("at"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("_w"), *keep[1:])
        events = events.unionByName(bounds)
    total = totals_in_buckets(events.withColumn("_bucket", bucket("at")), "at", ["_w"], ["variable"], ["kind", "y", "x"])
    signed = F.when(F.col("kind") == 0, F.col("_t_w")).otherwise(-F.col("_t_w"))
    found = total.where("kind <> 1").groupBy(*keep).agg(F.sum(signed).alias("m"))
    n = F.col("n")
    terms = digamma(F.col("k")) - digamma(F.col("size")) - digamma(F.col("m"))
    score = digamma(F.sum("n")) + F.sum(n * terms) / F.sum("n")
    return found.groupBy("variable").agg(F.greatest(score, F.lit(0.0)).alias("score"))
