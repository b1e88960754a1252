"""Nearest neighbours inside a jet, on rows, by cells.

A jet of up to ``DIRECT`` points, nearly every jet, is answered in one piece. A larger jet
gets a pyramid of grids, each with cells twice as wide as the one below, from finer than
its points are dense up to one cell. A point looks for the finest grid in which its own
cell holds k + 1 points: its k-th distance is then no longer than the diagonal of that
cell, and cells that wide or wider around it hold all its neighbours. So it is asked
once, in the cells around it of a grid that suits the place where it is.

Points with equal coordinates have equal answers: they are asked for once, and of so many
equal points only those with the smallest numbers can be among anyone's nearest. Cells
are cut into blocks and their questions into batches of bounded size; a block answers at
most k + 1 rows per question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.sources.io import materialise, shared_folder

#: Points of a jet that is answered in one piece: all its distances cost less than a pyramid, of which each point is in
#: every level and asked in 3 cells along each coordinate.
DIRECT = 4096
#: Points of a block of a cell, and questions of a batch, on average.
BLOCK, BATCH = 2048, 256
#: Distances worked on at once.
STEP = 1 << 20
#: The same for jets in one piece, alone or with others of their size: what a processor's cache holds.
PIECE = 1 << 16
#: So many neighbours are looked for one after the other, more by a sort.
FEW = 16


def closest(asked: np.ndarray, points: np.ndarray, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``asked`` its k nearest points, nearest first, equal distances by number: distances and numbers."""
    order = np.argsort(numbers, kind="stable")
    points, numbers = points[order], numbers[order]
    k = min(k, len(points))
    rows = max(1, STEP // max(1, len(points)))
    distances, found = [], []
    for at in range(0, len(asked), rows):
        square = np.zeros((len(asked[at : at + rows]), len(points)))
        for c in range(points.shape[1]):
            away = asked[at : at + rows, c, None] - points[None, :, c]
            square += away * away
        apart = np.sqrt(square)
        if k < len(points):  # whatever ties with the k-th stays for the sort
            limit = np.partition(apart, k - 1, axis=1)[:, k - 1 : k]
            apart = np.where(apart <= limit, apart, np.inf)
        near = np.argsort(apart, axis=1, kind="stable")[:, :k]
        distances.append(np.take_along_axis(apart, near, axis=1))
        found.append(numbers[near])
    return np.concatenate(distances), np.concatenate(found)


def _points(column: list, names: Sequence[str]) -> np.ndarray:
    return np.array([[p[c] for c in names] for p in column], float).reshape(len(column), len(names))


def _first(where: list[np.ndarray], asked: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest points, equal ones by place; ``where``: per coordinate jets x points."""
    square = np.zeros((where[0].shape[0], len(range(*asked.indices(where[0].shape[1]))), where[0].shape[1]))
    for x in where:
        away = x[:, asked, None] - x[:, None, :]
        square += away * away
    apart = np.sqrt(square)
    k = min(k, apart.shape[2])
    if k > FEW or not np.isfinite(apart.max()):
        near = np.argsort(apart, axis=2, kind="stable")[:, :, :k]
        return near, np.take_along_axis(apart, near, axis=2)
    near, found = np.empty((*apart.shape[:2], k), np.int64), np.empty((*apart.shape[:2], k))
    for nth in range(k):  # the least that is left, k times: no sort of whole rows
        at = np.argmin(apart, axis=2)[:, :, None]
        near[:, :, nth : nth + 1], found[:, :, nth : nth + 1] = at, np.take_along_axis(apart, at, axis=2)
        np.put_along_axis(apart, at, np.inf, axis=2)
    return near, found


def _small(points: DataFrame, key: list[str], names: list[str], k: int) -> DataFrame:
    """All answers of jets of bounded size: ``*key, i, nth, j, distance``. Jets of one size are worked on together."""
    grouped = points.groupBy(*key).agg(F.collect_list(F.struct("i", *names)).alias("points"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.compute.list_flatten(batch["points"])
            fields = {n: pa.compute.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in ("i", *names)}
            lengths = pa.compute.list_value_length(batch["points"]).to_numpy()
            starts = np.cumsum(lengths) - lengths
            for size in np.unique(lengths[lengths > 1]).tolist():
                alike = np.flatnonzero(lengths == size)
                most = max(1, PIECE // (size * size))
                for jets in (alike[at : at + most] for at in range(0, len(alike), most)):
                    at = starts[jets][:, None] + np.arange(size)
                    at = np.take_along_axis(at, np.argsort(fields["i"][at], axis=1, kind="stable"), axis=1)
                    numbers = fields["i"][at]
                    where = [fields[n][at] for n in names]
                    rows = max(1, PIECE // (len(jets) * size))
                    parts = [_first(where, slice(row, row + rows), k + 1) for row in range(0, size, rows)]
                    # the nearest is taken to be the point itself
                    near, apart = (np.concatenate(of, axis=1)[:, :, 1:] for of in zip(*parts))
                    wide = near.shape[2]
                    arrays = [
                        pa.array(np.repeat(numbers.reshape(-1), wide)),
                        pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(jets) * size)),
                        pa.array(numbers[np.arange(len(jets))[:, None, None], near].reshape(-1)),
                        pa.array(apart.reshape(-1)),
                    ]
                    rows = pa.array(np.repeat(jets, size * wide))
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in key), *arrays], [*key, "i", "nth", "j", "distance"])

    kinds = ", ".join(f"`{c}` {grouped.schema[c].dataType.simpleString()}" for c in key)
    return grouped.mapInArrow(answer, f"{kinds}, i long, nth int, j long, distance double")


def _answers(asked: DataFrame, given: DataFrame, key: list[str], names: list[str], k: int) -> DataFrame:
    """``*key, <coordinates>, nth, j, distance`` of every question; both sides lie in cells ``level, cell_<coordinate>``."""
    spot = [*key, "level", *[f"cell_{c}" for c in names]]
    given = given.join(asked.select(*spot).distinct(), spot, "left_semi")
    held = given.groupBy(*spot).agg(F.count(F.lit(1)).alias("held"))
    block = F.pmod(F.xxhash64(*names), F.ceil(F.col("held") / F.lit(float(BLOCK)))).alias("block")
    blocks = given.join(held, spot).groupBy(*spot, block).agg(F.collect_list(F.struct("who", *names)).alias("points"))
    wanted = asked.groupBy(*spot).agg(F.count(F.lit(1)).alias("wanted"))
    batch = F.pmod(F.xxhash64(*names, F.lit(1)), F.ceil(F.col("wanted") / F.lit(float(BATCH)))).alias("batch")
    batches = asked.join(wanted, spot).groupBy(*spot, batch).agg(F.collect_list(F.struct(*names)).alias("asked"))
    met = batches.join(blocks, spot).select(*key, "asked", "points")

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                asks, points = part["asked"][at].as_py(), part["points"][at].as_py()
                spread = [(p, n) for p in points for n in p["who"]]
                where = _points(asks, names)
                apart, near = closest(where, _points([p for p, _ in spread], names), np.array([n for _, n in spread]), k + 1)
                wide = near.shape[1]
                keys = [part[c].slice(at, 1).take(pa.array(np.zeros(len(where) * wide, int))) for c in key]
                coordinates = [pa.array(np.repeat(where[:, c], wide)) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*keys, *coordinates, pa.array(near.reshape(-1)), pa.array(apart.reshape(-1))], [*key, *names, "j", "distance"])

    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in key)
    found = met.mapInArrow(answer, f"{kinds}, " + ", ".join(f"`{c}` double" for c in names) + ", j long, distance double")
    order = Window.partitionBy(*key, *names).orderBy("distance", "j")
    return found.withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") <= k)


def _at_level(df: DataFrame, names: list[str], level: Column) -> DataFrame:
    """``df`` with a level and its cells, from those of the finest grid."""
    return df.withColumn("level", level).withColumns({f"cell_{c}": F.expr(f"shiftright(cell_{c}, level)") for c in names})


def nearest_rows(
    rows: DataFrame, key: Sequence[str], index: str, k: int, coordinates: Sequence[str] = ("eta", "phi")
) -> DataFrame:
    """The k nearest other points of every point of the same jet: ``*key, i, nth, j, distance``.

    ``index`` is a whole number, unique in its jet. The nearest entry is taken to be the
    point itself; equal distances are ordered by index. A jet of fewer points gives fewer.
    Points with a NULL, NaN or infinite coordinate have no neighbours and are nobody's.
    """
    key, names = list(key), [f"x{n}" for n in range(len(coordinates))]
    points = rows.select(*key, F.col(index).cast("long").alias("i"), *[F.col(c).cast("double").alias(n) for c, n in zip(coordinates, names)])
    for n in names:
        points = points.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(math.inf)))
    # zero of either sign is one coordinate
    points = points.withColumns({n: F.col(n) + F.lit(0.0) for n in names})
    extent = [x for n in names for x in (F.min(n).alias(f"low_{n}"), F.max(n).alias(f"high_{n}"))]
    sizes = points.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), *extent)
    large = sizes.where(F.col("size") > DIRECT)
    if large.isEmpty():
        return _small(points, key, names, k)
    small = points.join(sizes.where(F.col("size") <= DIRECT).select(*key), key, "left_semi")
    answers = _small(small, key, names, k)
    spark = rows.sparkSession
    # of equal points the k + 1 first; Spark limits each place before the shuffle
    place = Window.partitionBy(*key, *names).orderBy("i")
    first = points.join(large.select(*key), key, "left_semi").withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= k + 1)
    merged = first.groupBy(*key, *names).agg(F.sort_array(F.collect_list("i")).alias("who")).join(large, key)
    # the finest grid has eight times as many cells along a side as would hold one point each, the point
    # furthest out lies on the border of the widest, so one wider still holds the whole jet in a cell
    side = F.greatest(*[F.col(f"high_{n}") - F.col(f"low_{n}") for n in names]) if len(names) > 1 else F.col(f"high_{names[0]}") - F.col(f"low_{names[0]}")
    levels = F.ceil(F.log2(F.col("size").cast("double")) / F.lit(float(len(names)))) + F.lit(3)
    width = F.when(side > 0, side).otherwise(F.lit(1.0)) / F.pow(F.lit(2.0), levels)
    staged = merged.withColumn("width", width).withColumn("levels", levels.cast("int"))
    cells = {f"cell_{n}": F.floor((F.col(n) - F.col(f"low_{n}")) / F.col("width")).cast("long") for n in names}
    wanted = [*key, *names, "who", "width", "levels", *cells]
    places = materialise(staged.withColumns(cells).select(*wanted), shared_folder(spark))
    pyramid = _at_level(places, names, F.explode(F.sequence(F.lit(0), F.col("levels") + 1)))
    spot = [*key, "level", *[f"cell_{c}" for c in names]]
    crowd = pyramid.groupBy(*spot).agg(F.sum(F.size("who")).alias("crowd")).where(F.col("crowd") > k).select(*spot)
    finest = pyramid.join(crowd, spot, "left_semi").groupBy(*key, *names).agg(F.min("level").alias("finest"))
    # a cell's diagonal is this many doublings of its side at most; one more where the side itself would do, for rounding
    wider = int(math.log2(len(names)) / 2) + 1
    asked = _at_level(places.join(finest, [*key, *names]), names, (F.col("finest") + wider).cast("int"))
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    for c in names:
        asked = asked.withColumn("_s", F.explode(step)).withColumn(f"cell_{c}", F.col(f"cell_{c}") + F.col("_s")).drop("_s")
    given = _at_level(places, names, F.explode(F.sequence(F.lit(wider), F.col("levels") + 1 + wider)))
    lists = _answers(asked.select(*spot, *names), given.select(*spot, *names, "who"), key, names, k).where("nth > 0")
    big = points.join(large.select(*key), key, "left_semi").join(lists, [*key, *names])
    return answers.unionByName(big.select(*key, "i", "nth", "j", "distance"))


def edge_rows(near: DataFrame, rows: DataFrame, key: Sequence[str], index: str, features: Sequence[str]) -> DataFrame:
    """Per point and neighbour the centre's features and neighbour minus centre: ``*key, i, nth, j, <f>_centre, <f>_diff``."""
    key = list(key)
    own = rows.select(*key, F.col(index).cast("long").alias("i"), *[F.col(f).alias(f"{f}_centre") for f in features])
    other = rows.select(*key, F.col(index).cast("long").alias("j"), *[F.col(f).alias(f"{f}_other") for f in features])
    both = near.join(own, [*key, "i"]).join(other, [*key, "j"])
    differences = [(F.col(f"{f}_other") - F.col(f"{f}_centre")).alias(f"{f}_diff") for f in features]
    return both.select(*key, "i", "nth", "j", *[f"{f}_centre" for f in features], *differences)
