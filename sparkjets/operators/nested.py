"""Nested event -> jet -> constituent records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.functions.arrays import aligned_columns, explode_items, first_argmin, pad, pad_mask
from sparkjets.operators.ordered import number_rows
from sparkjets.operators.select import _open_interval

Limits = tuple[float | None, float | None]


def nest(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    columns: Mapping[str, str],
    max_items: int | None = None,
) -> DataFrame:
    """Long to nested: one row per key with aligned arrays in the given order.

    ``columns`` maps result -> source. With ``max_items`` only the first items
    of a key are kept; Spark then limits each key already before the shuffle,
    so a hot key sends at most ``max_items`` rows per task. Without it a key
    must fit in one row, which is what the nested form means.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    ranked = df.withColumn("_at", F.row_number().over(window))
    if max_items is not None:
        ranked = ranked.where(F.col("_at") <= max_items)
    item = F.struct(F.col("_at"), *[F.col(source).alias(name) for name, source in columns.items()])
    grouped = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return grouped.select(*keys, *[F.col("_items")[name].alias(name) for name in columns])


#: Items of a segment of a key.
SEGMENT = 4096


def nest_segments(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    tie_breakers: Sequence[str] = (),
    segment: int = SEGMENT,
    buckets=None,
) -> DataFrame:
    """Long to nested where a key may hold any number of items: one row per key and segment of it.

    ``order`` is numeric (ascending), ``tie_breakers`` finish it. Items are numbered by
    ordered buckets, so a key with a third of all items is spread over the tasks, and no
    row holds more than ``segment`` of them. Returns ``*keys, segment, start`` (items of the
    key before it) and the aligned arrays; read them with :func:`segment_totals`,
    :func:`first_of_segments` and :func:`explode_segments`, or any row function that needs no
    other item of the key.
    """
    numbered = number_rows(df, order, "_nth", keys, tie_breakers, buckets)
    at = F.floor((F.col("_nth") - 1) / F.lit(segment)).cast("long")
    item = F.struct("_nth", *[F.col(source).alias(name) for name, source in columns.items()])
    grouped = numbered.groupBy(*keys, at.alias("segment")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    start = (F.col("segment") * F.lit(segment)).alias("start")
    return grouped.select(*keys, "segment", start, *[F.col("_items")[name].alias(name) for name in columns])


def segment_totals(segments: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Per key the sums of numbers that each segment gives (``size``, a total over its arrays, ...)."""
    parts = segments.select(*keys, *[value.alias(name) for name, value in values.items()])
    return parts.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in values])


def first_of_segments(segments: DataFrame, count: int, names: Sequence[str]) -> DataFrame:
    """The first ``count`` items of every key, still in segments; segments beyond are never looked into."""
    left = F.lit(count) - F.col("start")
    inside = segments.where(F.col("start") < count)
    return inside.withColumns({n: F.slice(n, F.lit(1), F.least(left, F.size(n).cast("long")).cast("int")) for n in names})


def explode_segments(segments: DataFrame, keys: Sequence[str], names: Sequence[str], index: str = "index") -> DataFrame:
    """One row per item with its place in the whole key."""
    flat = segments.select(*keys, "start", F.posexplode(F.arrays_zip(*names)).alias("_at", "_item"))
    return flat.select(*keys, (F.col("start") + F.col("_at")).alias(index), *[F.col("_item")[n].alias(n) for n in names])


def _zipped(names: Sequence[str]) -> Column:
    return F.arrays_zip(*[F.col(n) for n in names])


def _unzip(df: DataFrame, names: Sequence[str], zipped: Column) -> DataFrame:
    return df.withColumn("_zip", zipped).withColumns({n: F.col("_zip")[n] for n in names}).drop("_zip")


def _element_test(wanted: Mapping[str, Sequence] | None, cuts: Mapping[str, Limits] | None):
    def test(x: Column) -> Column:
        result = None
        for name, (lower, upper) in (cuts or {}).items():
            one = _open_interval(x[name], lower, upper)
            result = one if result is None else result & one
        for name, values in (wanted or {}).items():
            one = x[name].isin(list(values))
            result = one if result is None else result & one
        return result

    return test


def filter_elements(df, reference: str, wanted: Sequence, key_phrase="jets", columns=None) -> DataFrame:
    """Keep array positions whose reference value is wanted, in every aligned array."""
    names = aligned_columns(df, key_phrase, columns)
    return _unzip(df, names, F.filter(_zipped(names), _element_test({reference: wanted}, None)))


def cut_elements(df, variable: str, lower=None, upper=None, key_phrase="jets", columns=None) -> DataFrame:
    """Keep array positions strictly inside the limits, in every aligned array."""
    names = aligned_columns(df, key_phrase, columns)
    return _unzip(df, names, F.filter(_zipped(names), _element_test(None, {variable: (lower, upper)})))


def first_elements(df, max_items: int, key_phrase="jets", columns=None) -> DataFrame:
    """The first ``max_items`` positions of every aligned array."""
    names = aligned_columns(df, key_phrase, columns)
    return df.withColumns({n: F.slice(F.col(n), 1, max_items) for n in names})


def drop_empty(df: DataFrame, reference: str) -> DataFrame:
    return df.where(F.size(reference) > 0)


def explode_aligned(df, key_phrase="jets", columns=None, index="jets_index") -> DataFrame:
    """One row per array position; other columns are repeated. Records without elements vanish."""
    names = aligned_columns(df, key_phrase, columns)
    rest = [c for c in df.columns if c not in names]
    flat = explode_items(df, rest, _zipped(names), "_item", index)
    return flat.select(*rest, index, *[F.col("_item")[n].alias(n) for n in names])


def flatten_events(
    df: DataFrame,
    reference: str | None = None,
    wanted: Sequence | None = None,
    cuts: Mapping[str, Limits] | None = None,
    max_items: int | None = None,
    drop: Sequence[str] = (),
    key_phrase: str = "jets",
    columns: Sequence[str] | None = None,
    index: str = "jets_index",
) -> DataFrame:
    """Events to jets: drop columns, take the first jets, cut, keep wanted values, explode.

    The aligned arrays are zipped once and walked once; nothing is shuffled.
    """
    df = df.drop(*drop)
    names = aligned_columns(df, key_phrase, columns)
    rest = [c for c in df.columns if c not in names]
    jets = _zipped(names)
    if max_items is not None:
        jets = F.slice(jets, 1, max_items)
    if cuts or wanted is not None:
        jets = F.filter(jets, _element_test({reference: wanted} if wanted is not None else None, cuts))
    flat = explode_items(df, rest, jets, "_item", index)
    return flat.select(*rest, index, *[F.col("_item")[n].alias(n) for n in names])


def explode_to_scalars(df: DataFrame, columns: Sequence[str], max_levels: int = 5) -> DataFrame:
    """Unnest array columns until they hold scalars; columns of one depth unnest in step."""
    for _ in range(max_levels):
        nested = [c for c in columns if isinstance(df.schema[c].dataType, T.ArrayType)]
        if not nested:
            return df
        rest = [c for c in df.columns if c not in nested]
        flat = explode_items(df, rest, _zipped(nested))
        df = flat.select(*rest, *[F.col("_item")[n].alias(n) for n in nested])
    return df


def central_jet_flags(df: DataFrame, eta: str = "jets_eta", out: str = "jets_is_central") -> DataFrame:
    """Per jet: is it the one with the smaller \\|eta\\| of the first two jets."""
    candidates = [F.coalesce(F.abs(F.get(F.col(eta), F.lit(i))), F.lit(float("inf"))) for i in (0, 1)]
    chosen = first_argmin(candidates)
    return df.withColumn(out, F.transform(F.col(eta), lambda _, i: (i == chosen).cast("int")))


def pad_records(
    df: DataFrame,
    size: int,
    pad_value: float = 0.0,
    node: str | None = None,
    edge: str | None = None,
    mask: str | None = "mask",
) -> DataFrame:
    """Fixed-size records: a node array of structs to ``[size]``, an edge matrix to ``[size, size]``, and a mask."""

    def blank(kind: T.StructType) -> Column:
        return F.struct(*[F.lit(float(pad_value)).cast(f.dataType).alias(f.name) for f in kind.fields])

    changes: dict[str, Column] = {}
    if mask is not None:  # on its own: inside one withColumns call a lambda would see the padded array
        df = df.withColumn(mask, pad_mask(F.col(node or edge), size))
    if node is not None:
        kind = _field_type(df, node).elementType
        empty = blank(kind) if isinstance(kind, T.StructType) else F.lit(float(pad_value)).cast(kind)
        changes[node] = pad(F.col(node), size, empty)
    if edge is not None:
        kind = _field_type(df, edge).elementType.elementType
        empty = blank(kind) if isinstance(kind, T.StructType) else F.lit(float(pad_value)).cast(kind)
        rows = F.transform(F.col(edge), lambda row: pad(row, size, empty))
        changes[edge] = pad(rows, size, F.array_repeat(empty, size))
    return df.withColumns(changes)


def _field_type(df: DataFrame, path: str) -> T.DataType:
    return df.select(F.col(path)).schema[0].dataType
