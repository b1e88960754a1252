"""Take, split, shuffle and batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.functions.random import random_order, uniform
from sparkjets.operators.ordered import HASH_BUCKETS, cut_order, keep_first, number_rows

#: Rows that one task may sort and hand on.
DIRECT = 100_000


def _as_number(df: DataFrame, name: str) -> Column:
    """A double that never decreases in the order of the column; equal where the order needs more than it."""
    kind = dict(df.dtypes)[name]
    if kind in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double")


def take_first(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a given order; NULLs come first.

    Up to ``DIRECT`` rows Spark keeps the first of every task and merges them. Beyond, rows go
    through buckets of the leading column, so that no task holds all ``n`` rows.
    """
    if n <= DIRECT:
        return df.orderBy(*order).limit(n)
    leading = df.withColumn("_lead", _as_number(df, order[0]))
    return keep_first(leading, "_lead", F.lit(n), tie_breakers=list(order)).drop("_lead")


def _check_fractions(parts: Mapping[str, float]) -> None:
    if abs(sum(parts.values()) - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")


def split_contiguous(df: DataFrame, parts: Mapping[str, float], order: str, out: str = "split") -> DataFrame:
    """Cut the ordered rows into consecutive parts; the last part takes the remainder.

    ``order`` is a unique numeric row id. Rows stay where they are, but for
    those in the buckets at the cuts.
    """
    _check_fractions(parts)
    size = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    names = list(parts)
    cuts, end = [], F.lit(0)
    for name in names[:-1]:
        end = end + F.floor(size * F.lit(float(parts[name])))
        cuts.append(end)
    tagged = cut_order(df, order, cuts, "_segment")
    return tagged.withColumn(out, F.get(F.array(*[F.lit(n) for n in names]), F.col("_segment"))).drop("_segment")


def split_random(df: DataFrame, parts: Mapping[str, float], key: str, out: str = "split", seed: int = 42):
    """One draw per row decides its part, so the parts are disjoint and complete. No shuffle."""
    _check_fractions(parts)
    names = list(parts)
    draw, edge, tag = uniform(key, seed=seed), 0.0, None
    for name in names[:-1]:
        edge += parts[name]
        tag = F.when(draw <= edge, name) if tag is None else tag.when(draw <= edge, name)
    return df.withColumn(out, F.lit(names[-1]) if tag is None else tag.otherwise(names[-1]))


def shuffle(df: DataFrame, key: str | Sequence[str], seed: int = 42, parts: int | None = None) -> DataFrame:
    """Global random order, by two levels: a draw deals the rows to ``parts`` tasks, each sorts its own by the draw.

    Draws are spread evenly, so nothing is sampled and no range is cut; read part after
    part the rows come in the order of their draws, whatever the number of parts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = df.withColumn("_order", random_order(*keys, seed=seed))
    # the highest 32 of the 60 bits, so that the product stays in whole numbers
    part = (F.shiftright("_order", 32) + F.lit(1 << 31)) * parts
    placed = drawn.repartitionById(parts, F.shiftright(part, 32).cast("int"))
    return placed.sortWithinPartitions("_order", *keys).drop("_order")


def batches(
    df: DataFrame,
    batch_size: int,
    order: str,
    columns: Sequence[str],
    shuffle_seed: int | None = None,
    take: int | None = None,
) -> DataFrame:
    """Fixed-size batches: ``batch, size`` and one array per column, in row order.

    A batch never holds more than ``batch_size`` rows. With ``shuffle_seed`` the
    rows are batched in a hashed order.
    """
    lead, buckets = order, None
    if shuffle_seed is not None:
        df = df.withColumn("_order", random_order(order, seed=shuffle_seed))
        lead, buckets = "_order", HASH_BUCKETS
    if take is not None:
        df = take_first(df, take, [lead])
    numbered = number_rows(df, lead, "_nth", tie_breakers=[order], buckets=buckets)
    batch = F.floor((F.col("_nth") - 1) / batch_size).cast("long")
    items = F.sort_array(F.collect_list(F.struct("_nth", *columns)))
    grouped = numbered.groupBy(batch.alias("batch")).agg(items.alias("_items"))
    return grouped.select("batch", F.size("_items").alias("size"), *[F.col("_items")[c].alias(c) for c in columns])


def has_rows(df: DataFrame, expected: int) -> DataFrame:
    """The row count, failing the query when it is not the expected one."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    message = F.concat(F.lit(f"expected {expected} rows, found "), F.col("n").cast("string"))
    return n.select(F.when(F.col("n") == expected, F.col("n")).otherwise(F.raise_error(message).cast("long")).alias("n"))
