"""Pair features of jets of any size, in tiles.

The constituents of a jet stay rows. A jet with more than ``TILE`` of them is cut into
blocks by a hash, and every two blocks (and each with itself) meet in a tile of their
own: a triangular self-join on (jet, block, block) in one shuffle, so a jet with a third
of all constituents is spread over all tasks and no row or group holds more than two
blocks. Jets of one block, nearly all, are grouped where the count of their constituents
has put them already and are not shuffled again.

A tile is worked on by the batch kernel or, with ``engine="builtin"``, by built-in
expressions; it gives sums (:func:`pair_sums`) or cells as rows (:func:`pair_cells`).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.functions import pair_kernel, vectors
from sparkjets.functions.arrays import let
from sparkjets.functions.features import pair_cell
from sparkjets.functions.numeric import hypot, ratio

#: Constituents of a block on average.
TILE = 256
#: What the kernel needs of a constituent; ``angle`` is eta or the rapidity.
VALUES = ("pt", "angle", "phi", "E", "px", "py", "pz")
FEATURES = ("delta", "k_t", "z", "m2")

#: How the pair features of a set look at the constituents: the axis they are taken relative to, the angle, the form of z.
PAIR_SETS: dict[str, dict] = {
    "int_const": {},
    "int_rel_const": {"axis": True},
    "int_rel_const2": {"axis": True},
    "jet_class": {"angle": "y", "wrap": True, "log_z": True},
}


def with_momenta(rows: DataFrame) -> DataFrame:
    """Constituent rows (m, pt, eta, phi) with E, px, py, pz."""
    p = vectors.cartesian(*[F.col(k).cast("double") for k in ("m", "pt", "eta", "phi")])
    return rows.withColumns({"pt": F.col("pt").cast("double"), **p})


def _bounded(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(1e-10)), F.lit(1e10))


def _axis_sums() -> list[Column]:
    return [*(F.sum(k).alias(f"_s{k}") for k in ("px", "py", "pz")), F.sum(_bounded(F.col("E"))).alias("_sE")]


def _relative(rows: DataFrame) -> DataFrame:
    """Momenta in units of the pt of the summed axis, angles relative to it."""
    staged = rows.withColumn("_apt", _bounded(hypot(F.col("_spx"), F.col("_spy"))))
    angles = {"eta": F.asinh(ratio(F.col("_spz"), F.col("_apt"))), "phi": F.atan2("_spy", "_spx")}
    return staged.withColumns(
        {k: F.col(k) - angle for k, angle in angles.items()} | {k: ratio(F.col(k), F.col("_apt")) for k in ("pt", "E", "px", "py", "pz")}
    )


def tiles(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], axis: bool = False, angle: str = "eta", index: str | None = None
) -> DataFrame:
    """One row per tile: ``*key, n`` (constituents of the jet), ``lo, hi`` (its blocks), ``a, b`` (their constituents).

    ``rows`` carry momenta. ``order`` tells the constituents of a jet apart; those equal
    in all of it share a block. A tile of one block with itself has an empty ``b``.
    """
    key = list(key)
    sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(_axis_sums() if axis else []))
    joined = rows.join(sums.withColumn("_m", F.ceil(F.col("n") / F.lit(float(TILE)))), key)
    joined = _relative(joined) if axis else joined
    fields = [F.col(angle if v == "angle" else v).cast("double").alias(v) for v in VALUES]
    if index is not None:
        fields.append(F.col(index).cast("long").alias("index"))
    item = F.struct(*fields)
    one = joined.where("_m = 1").groupBy(*key, "n").agg(F.collect_list(item).alias("a"))
    one = one.select(*key, "n", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "a", F.filter("a", lambda x: F.lit(False)).alias("b"))
    block = F.pmod(F.xxhash64(*order), F.col("_m")).cast("int")
    placed = joined.where("_m > 1").select(*key, "n", item.alias("item"), block.alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_m").cast("int") - 1)).alias("_y"))
    met = placed.select(*key, "n", F.least("_x", "_y").alias("lo"), F.greatest("_x", "_y").alias("hi"), "_x", "item")
    met = met.repartition(*key, "lo", "hi")  # not by the jet alone
    side = lambda at: F.collect_list(F.when(F.col("_x") == F.col(at), F.col("item")))
    many = met.groupBy(*key, "n", "lo", "hi").agg(side("lo").alias("a"), side("hi").alias("b"))
    many = many.where("size(a) > 0 AND size(b) > 0")  # a block may have drawn no constituent
    many = many.withColumn("b", F.when(F.col("lo") == F.col("hi"), F.filter("b", lambda x: F.lit(False))).otherwise(F.col("b")))
    return one.unionByName(many)


def _pair_indices(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile, first and second place of every ordered pair; places count from each tile's first constituent."""
    wide = np.where(n_b > 0, n_b, n_a)
    pairs = n_a * wide
    tile = np.repeat(np.arange(len(n_a)), pairs)
    place = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    i = place // np.maximum(wide[tile], 1)
    j = place - i * wide[tile] + np.where(n_b[tile] > 0, n_a[tile], 0)
    return tile, i, j


def _tile_steps(batch: pa.RecordBatch, options: dict) -> Iterator[tuple]:
    """Runs of tiles of a batch with at most about ``PAIRS_PER_STEP`` pairs: their rows, pairs and features."""
    n_a, n_b = (pa.compute.list_value_length(batch[s]).to_numpy() for s in "ab")
    pairs = n_a * np.where(n_b > 0, n_b, n_a)
    begin = 0
    while begin < batch.num_rows:
        held = np.cumsum(pairs[begin:])
        end = begin + max(1, int(np.searchsorted(held, pair_kernel.PAIRS_PER_STEP, "right")))
        part = batch.slice(begin, end - begin)
        a, b = n_a[begin:end], n_b[begin:end]
        tile, i, j = _pair_indices(a, b)
        starts = np.cumsum(a + b) - (a + b)
        # constituents of a tile one after the other, those of block a first
        order = np.argsort(np.concatenate([np.repeat(2 * np.arange(len(a)), a), np.repeat(2 * np.arange(len(b)) + 1, b)]), kind="stable")
        flat = [pa.compute.list_flatten(part[s]) for s in "ab"]
        values = {
            f.name: np.concatenate([pa.compute.struct_field(x, f.name).to_numpy(zero_copy_only=False) for x in flat])[order]
            for f in flat[0].type
        }
        at_i, at_j = starts[tile] + i, starts[tile] + j
        columns = [values[v] for v in VALUES]
        features, undefined = pair_kernel.pair_features(columns, at_i, at_j, **options)
        yield part, tile, at_i, at_j, features, undefined, values, (b > 0)[tile]
        begin = end


def _keys(part: pa.RecordBatch, key: Sequence[str]) -> list[pa.Array]:
    return [part[k] for k in key]


def pair_sums(
    tiled: DataFrame,
    key: Sequence[str],
    sums: Mapping[str, tuple[str, str | None, float]],
    wrap: bool = False,
    log_z: bool = False,
    engine: str = "arrow",
) -> DataFrame:
    """Per jet ``*key, cells`` (n squared) and sums over its off-diagonal cells.

    ``sums`` maps a name to (feature, guard, floor): the feature is summed where the guard
    is above the floor (everywhere without a guard). Both orders of a pair count. Cells that
    have no value (z of two constituents without pt) add nothing.
    """
    key = list(key)
    if engine not in ("arrow", "builtin"):
        raise ValueError(f"unknown engine {engine!r}")
    if engine == "builtin":
        parts = tiled.select(*key, "n", _builtin_sums(sums, wrap, log_z).alias("s")).select(*key, "n", *(F.col(f"s.{s}").alias(s) for s in sums))
    else:
        options = {"wrap": wrap, "log_z": log_z}

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, tile, i, j, features, undefined, _, cross in _tile_steps(batch, options):
                    times = np.where(cross, 2.0, (i != j).astype(float))
                    totals = []
                    for feature, guard, floor in sums.values():
                        counted = times if guard is None else np.where(features[guard] > floor, times, 0.0)
                        counted = np.where(undefined, 0.0, counted) if feature == "z" else counted
                        value = np.where(counted > 0, features[feature], 0.0)
                        totals.append(pa.array(np.bincount(tile, value * counted, part.num_rows)))
                    yield pa.RecordBatch.from_arrays([*_keys(part, key), part["n"], *totals], [*key, "n", *sums])

        kinds = ", ".join(f"`{k}` {tiled.schema[k].dataType.simpleString()}" for k in [*key, "n"])
        parts = tiled.select(*key, "n", "a", "b").mapInArrow(add, f"{kinds}, " + ", ".join(f"`{s}` double" for s in sums))
    return parts.groupBy(*key, (F.col("n") * F.col("n")).alias("cells")).agg(*(F.sum(s).alias(s) for s in sums))


def _builtin_sums(sums: Mapping[str, tuple[str, str | None, float]], wrap: bool, log_z: bool) -> Column:
    """The same sums of one tile as a struct of built-in expressions."""
    zero = F.struct(*(F.lit(0.0).alias(s) for s in sums))

    def grown(acc: Column, f: Column, times: Column) -> Column:
        fields = []
        for name, (feature, guard, floor) in sums.items():
            counts = f[feature].isNotNull() if guard is None else f[guard] > F.lit(float(floor))
            fields.append((acc[name] + F.when(counts, f[feature] * times).otherwise(F.lit(0.0))).alias(name))
        return F.struct(*fields)

    def with_all(acc: Column, x: Column, others: Column, times) -> Column:
        return F.aggregate(others, acc, lambda s, y: let(pair_cell(x, y["x"], "angle", wrap, log_z), lambda f: grown(s, f, times(y["i"]))))

    numbered = lambda c: F.transform(c, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    cross = F.aggregate("a", zero, lambda acc, x: with_all(acc, x, numbered(F.col("b")), lambda i: F.lit(2.0)))
    own = F.aggregate(
        numbered(F.col("a")), zero,
        lambda acc, p: F.aggregate(
            F.filter(numbered(F.col("a")), lambda y: y["i"] != p["i"]), acc,
            lambda s, y: let(pair_cell(p["x"], y["x"], "angle", wrap, log_z), lambda f: grown(s, f, F.lit(1.0))),
        ),
    )
    return F.when(F.size("b") > 0, cross).otherwise(own)


def pair_cells(tiled: DataFrame, key: Sequence[str], wrap: bool = False, log_z: bool = False) -> DataFrame:
    """Every cell as a row: ``*key, i, j, delta, k_t, z, m2``; i and j are the constituents' ``index``, zero on the diagonal.

    ``tiled`` was made with ``index``. Rows leave a task in steps of bounded size.
    """
    key = list(key)
    options = {"wrap": wrap, "log_z": log_z}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tile, i, j, features, undefined, values, cross in _tile_steps(batch, options):
                own = [k.take(pa.array(tile)) for k in _keys(part, key)]
                for v in features.values():
                    v[i == j] = 0.0
                cells = [pa.array(v, mask=undefined & (i != j) if f == "z" else None) for f, v in features.items()]
                first, second = pa.array(values["index"][i]), pa.array(values["index"][j])
                yield pa.RecordBatch.from_arrays([*own, first, second, *cells], [*key, "i", "j", *FEATURES])
                mirrored = pa.RecordBatch.from_arrays([*own, second, first, *cells], [*key, "i", "j", *FEATURES])
                yield mirrored.filter(pa.array(cross))

    kinds = ", ".join(f"`{k}` {tiled.schema[k].dataType.simpleString()}" for k in key)
    return tiled.select(*key, "a", "b").mapInArrow(spread, f"{kinds}, i long, j long, " + ", ".join(f"{f} double" for f in FEATURES))
