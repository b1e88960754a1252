"""Helpers for arrays that are aligned by position."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aligned_columns(df: DataFrame, key_phrase: str = "jets", columns: Sequence[str] | None = None) -> list[str]:
    """Array columns that run in step: the ones named, else those whose name holds ``key_phrase``."""
    if columns is not None:
        return list(columns)
    return [f.name for f in df.schema.fields if key_phrase in f.name and isinstance(f.dataType, T.ArrayType)]


def zip_columns(names: Mapping[str, str]) -> Column:
    """Zip array columns into one ``array<struct>``; ``names`` maps field -> column."""
    zipped = F.arrays_zip(*[F.col(c) for c in names.values()])
    return F.transform(zipped, lambda s: F.struct(*[s[c].alias(f) for f, c in names.items()]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Inside lambdas Spark has no common-subexpression elimination: a Python
    variable that holds a Column is copied into every place it is used.
    """
    return F.transform(F.array(value), body)[0]


def explode_items(df: DataFrame, keep: Sequence, array, item: str = "_item", index: str = "_index") -> DataFrame:
    """One row per element, with its position.

    The outer form plus a filter on the position: for the inner form Spark may
    infer a ``size(array) > 0`` filter and push it below the projection that
    makes the array, which computes the array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(index, item))
    return rows.where(F.col(index).isNotNull())


def total(array: Column, value: Callable[[Column], Column] = lambda x: x) -> Column:
    """Sum of ``value(element)`` over an array."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))


def pad(array: Column, size: int, value: Column) -> Column:
    """Exactly ``size`` elements: truncated, or filled up with ``value``."""
    return F.slice(F.concat(array, F.array_repeat(value, size)), 1, size)


def pad_mask(array: Column, size: int) -> Column:
    """True where :func:`pad` kept an original element."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i <= F.size(array))


def one_hot(index: Column, size: int) -> Column:
    """Vector of ``size`` doubles with a one at ``index``; all zero when it is out of range."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))


def first_argmin(values: Sequence[Column]) -> Column:
    """Index of the smallest value, the first one on ties."""
    return F.array_min(F.array(*[F.struct(v.alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)]))["i"]


def argmax(array: Column) -> Column:
    """Zero-based index of the largest element, the first one on ties."""
    return F.array_position(array, F.array_max(array)).cast("int") - 1
