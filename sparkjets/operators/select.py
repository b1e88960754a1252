"""Projections and row filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.functions import labels
from sparkjets.functions.arrays import argmax
from sparkjets.functions.lang import Cut, expression, row_query


def map_columns(df: DataFrame, fn: Callable[[DataFrame], Mapping[str, Column]]) -> DataFrame:
    """Record map: ``fn`` names the columns of the result."""
    return df.select(*[c.alias(name) for name, c in fn(df).items()])


def pick(df: DataFrame, variables: Sequence[str] | None = None, target: str | None = None, weight: str | None = None):
    """Features as a struct, with the target and weight beside it.

    Every name may be an expression text; a feature is called by its text.
    """
    names = [v for v in (df.columns if variables is None else variables) if v not in (target, weight)]
    features = F.struct(*[expression(df, v).alias(v) for v in names]).alias("features")
    if target is None:
        return df.select(features)
    columns = [features, expression(df, target).alias("label")]
    if weight is not None:
        columns.append(expression(df, weight).alias("weight"))
    return df.select(*columns)


def multilabel(df: DataFrame, flags: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, labels.last_flag([F.col(f) for f in flags]))


def remap_labels(df: DataFrame, fn: Callable[[Column], Column], label: str = "label") -> DataFrame:
    return df.withColumn(label, fn(F.col(label)))


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the listed columns, those that exist."""
    return df.drop(*names)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name matches a regular expression anywhere."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not re.search(pattern, c)])


def add_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def leading(df: DataFrame, prefix: str) -> DataFrame:
    """Columns that start with ``prefix``, without it; arrays give their first element."""
    columns = []
    for field in df.schema.fields:
        if field.name.startswith(prefix):
            column = F.col(f"`{field.name}`")
            if isinstance(field.dataType, T.ArrayType):
                column = F.get(column, F.lit(0))
            columns.append(column.alias(field.name[len(prefix):]))
    return df.select(*columns)


def variables(df: DataFrame) -> list[str]:
    """Column names; the fields of struct columns count as variables of their own."""
    names: list[str] = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            names += [f.name for f in field.dataType.fields]
        else:
            names.append(field.name)
    return names


def to_table(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Flat table for export: feature struct unpacked, one-hot label as an index, weight 1 when absent."""
    columns: list[Column] = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            columns += [F.col(f"`{field.name}`")[f.name].alias(f.name) for f in field.dataType.fields]
        elif field.name == "label":
            is_vector = isinstance(field.dataType, T.ArrayType)
            columns.append((argmax(F.col("label")) if is_vector else F.col("label").cast("int")).alias("label"))
        else:
            columns.append(F.col(f"`{field.name}`"))
    flat = df.select(*columns)
    if "label" in flat.columns and "weight" not in flat.columns:
        flat = flat.withColumn("weight", F.lit(1.0))
    if names is not None:
        extra = [c for c in ("label", "weight") if c in flat.columns and c not in names]
        flat = flat.select(*[F.col(f"`{n}`") for n in (*names, *extra)])
    return flat.toDF(*[c.replace("/", ".") for c in flat.columns])


# ------------------------------------------------------------------- filters


def where(df: DataFrame, condition: str | Cut | Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Filter by a cut, query text, column or function of the frame."""
    if isinstance(condition, Cut):
        condition = condition.column(df)
    elif isinstance(condition, str):
        condition = row_query(df, condition)
    elif not isinstance(condition, Column):
        condition = condition(df)
    return df.where(condition)


def _is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def _open_interval(x: Column, lower, upper) -> Column:
    if lower is None and upper is None:
        raise ValueError("give a lower or an upper limit")
    parts = []
    if lower is not None:
        parts.append((x > F.lit(lower)) & ~F.isnan(x.cast("double")))
    if upper is not None:
        parts.append(x < F.lit(upper))
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def cut(df: DataFrame, variable: str, lower=None, upper=None) -> DataFrame:
    """Rows strictly inside the limits; an array column must be inside with every element."""
    if _is_array(df, variable):
        return df.where(F.forall(F.col(variable), lambda x: _open_interval(x, lower, upper)))
    return df.where(_open_interval(F.col(variable), lower, upper))


def keep_values(df: DataFrame, variable: str, values: Sequence) -> DataFrame:
    """Rows whose value is listed; an array column must hold at least one listed value."""
    if _is_array(df, variable):
        return df.where(F.exists(F.col(variable), lambda x: x.isin(list(values))))
    return df.where(F.col(variable).isin(list(values)))


def drop_values(df: DataFrame, variable: str, values: Sequence) -> DataFrame:
    """Drop rows with an unknown label; NULL labels stay."""
    return df.where(F.coalesce(~F.col(variable).isin(list(values)), F.lit(True)))


# Upper pT edge of each generator slice, in GeV.
SLICE_UPPER_GEV = (60, 160, 400, 800, 1300, 1800, 2500, 3200, 3900, 4600, 5300, 7000)
SLICE_MARGIN = 1.4


def slice_number(name: Column) -> Column:
    """Slice number in a sample name such as ``..._JZ4_...``; NULL when there is none."""
    digits = F.regexp_extract(name, r"JZ(\d+)", 1)
    return F.when(digits != "", digits.cast("int"))


def slice_cut(df: DataFrame, slice_id: Column, pt: str = "jets_pt", upper=None, margin: float = SLICE_MARGIN):
    """Keep jets below ``margin`` times the upper edge of their slice (slices count from 1)."""
    edges = [v * 1e3 for v in SLICE_UPPER_GEV] if upper is None else list(upper)
    limit = F.get(F.array(*[F.lit(float(margin * e)) for e in edges]), slice_id.cast("int") - 1)
    return df.where(F.col(pt) < limit)
