"""Hard negatives by an inverted multi-index over embeddings.

Vectors are cut into two halves. A codebook per half, fitted on a bounded sample, turns
every vector into a pair of codes: its cell. A query q has for each code i of a half the
bound ``<q_h, c_i> + |q_h| r_i`` (r_i: the largest distance of a member's half to the
codeword), and no vector of cell (i, j) scores more than the sum of both bounds. A
multi-sequence heap walks the cells in descending order of that sum. A window of scores
is certified, and its anchor done, as soon as the bound of the next cell is below the
last score wanted, or below the window.

On Spark an anchor visits cells in two rounds: the heap's first cells until ``FIRST``
vectors are seen, whose best rows say how low the rest of a window can end, and then, where
that is not certified, every cell whose bound reaches down to there. No list of cells is
kept: an anchor carries the bound down to which it goes, and the cells of a block follow
from its codebooks. Cells lie in blocks of bounded size (large cells have several).
Anchors from near each other share a batch of bounded size, a batch meets the blocks that
any of its anchors visits, and a task keeps the best rows of each window over all blocks
it sees. First come the positives of all anchors, then their negatives, whose windows
the positives define. Everything between rounds is a table.

A score is the product of floor(256 * x) of all components, exact for any finite
component; beyond 64 bits it is held at their ends. Higher scores come first, ties go to
smaller ids. Rows with a null id, label or vector, or a null or non-finite component
take no part. Every row of a repeated id takes part; rows that carry an anchor's id are
not its candidates. Vectors of different lengths never meet.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.llm.common import forget, keep

SCALE = 256
#: Codes of a half at most, and vectors of a cell on average until then.
CODES, CELL = 256, 32
#: Vectors that the codebooks are fitted on: so many per code, and at most; passes of the fit.
PER_CODE, SAMPLE, PASSES = 32, 8192, 10
#: Vectors of a block on average, anchors that meet it at once, vectors of an anchor's first round.
BLOCK, BATCH, FIRST = 4096, 256, 16384
#: Numbers that a task keeps for the windows it has met (rows wanted, components), rows that it takes or hands over at once.
HELD, HANDED = 1 << 22, 1 << 16
EXACT, EXACT_FLOAT = 1 << 53, 1 << 24
LONGEST = (1 << 63) - 1


def codebook(sample: np.ndarray, k: int, passes: int = PASSES) -> np.ndarray:
    """k-means codewords, seeded by the first ``k`` of the sample."""
    words = sample[:k].copy()
    for _ in range(passes):
        code = nearest(sample, words)
        sums = np.zeros_like(words)
        np.add.at(sums, code, sample)
        count = np.bincount(code, minlength=k)
        words[count > 0] = sums[count > 0] / count[count > 0, None]
    return words


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * points @ words.T).argmin(axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as 64-bit integers: in floats or doubles where these are exact."""
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < EXACT_FLOAT:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).dot(whole(b).T)
    return np.clip(exact, -LONGEST - 1, LONGEST).astype(np.int64)


class Index:
    """Codebooks, radii and the places of the occupied cells of vectors of one length; bounded by ``CODES`` squared."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.radii = [np.zeros(len(w)) for w in words]
        #: vectors of each cell, and the bundle of blocks it lies in
        self.size = np.zeros((len(words[0]), len(words[1])), np.int64)
        self.bundle = np.full(self.size.shape, -1, np.int64)

    def bounds(self, query: np.ndarray, codes: tuple = (slice(None), slice(None))) -> list[np.ndarray]:
        """Per half, what no member of a code can exceed, for a query or rows of queries; widened against rounding."""
        half = len(self.words[0][0])
        out = []
        for part, words, radii, own in zip((query[..., :half], query[..., half:]), self.words, self.radii, codes):
            words, radii = words[own], radii[own]
            length = np.sqrt((part * part).sum(axis=-1, keepdims=True))
            top = part @ words.T + length * radii
            slack = np.abs(part) @ np.abs(words).T + length * radii
            out.append(top + 1e-9 * slack + 1e-6)
        return out

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Occupied cells ``(bound, i, j)``, highest bound first, by a multi-sequence heap over both sorted halves."""
        first, second = self.bounds(query)
        by_first, by_second = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
        first, second = np.sort(first)[::-1].tolist(), np.sort(second)[::-1].tolist()
        size = self.size
        heap = [(-(first[0] + second[0]), 0, 0)]
        while heap:
            below, x, y = heapq.heappop(heap)
            # (x, y + 1) follows (x, y), and (x + 1, 0) follows (x, 0): every pair is pushed once, after a greater one
            if y + 1 < len(second):
                heapq.heappush(heap, (-(first[x] + second[y + 1]), x, y + 1))
            if y == 0 and x + 1 < len(first):
                heapq.heappush(heap, (-(first[x + 1] + second[0]), x + 1, 0))
            i, j = by_first[x], by_second[y]
            if size[i, j]:
                yield -below, i, j


def visits(index: Index, query: np.ndarray, done: int, budget: int) -> tuple[dict[int, list[int]], int, float]:
    """Cells of the next round by bundle, the number of cells walked by then, and the bound of what is left."""
    taken: dict[int, list[int]] = {}
    held = walked = 0
    codes = index.size.shape[1]
    for bound, i, j in index.cells(query):
        if walked >= done:
            if held >= budget:
                return taken, walked, bound
            held += int(index.size[i, j])
            taken.setdefault(int(index.bundle[i, j]), []).append(i * codes + j)
        walked += 1
    return taken, walked, -math.inf


def prepare(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Kept ``rid, id, label, v`` of the rows that take part; ``rid`` tells rows of one id apart."""
    # beyond 2^53 a scaled component is whole as it is, and a 64-bit floor would not hold it
    exact = lambda y: F.when(F.abs(y) < F.lit(float(EXACT)), F.floor(y).cast("double")).otherwise(y)
    whole = F.transform(embedding, lambda x: exact(x.cast("double") * F.lit(float(SCALE))))
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = vectors.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & F.coalesce(ok, F.lit(False)))
    rows = rows.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    return keep(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), length)


def _packed(points: np.ndarray) -> bytes:
    """Rows of whole numbers: in 16 bits each where these hold all of them, else as doubles."""
    return points.astype("<i2" if np.abs(points).max(initial=0) < 1 << 15 else "<f8").tobytes()


def _unpacked(data: bytes, count: int, length: int) -> np.ndarray:
    kind = "<i2" if len(data) == 2 * count * length else "<f8"
    return np.frombuffer(data, kind).astype(float).reshape(count, length)


def _rows(column: pa.ChunkedArray, length: int) -> np.ndarray:
    """Vectors that were packed one by one or in groups."""
    rows = column.to_pylist()
    if len({len(v) for v in rows}) < 2:
        return _unpacked(b"".join(rows), len(rows), length)
    return np.concatenate([_unpacked(v, 1, length) for v in rows])


def _coded(rows: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """``rows`` with their cells and the distances of both halves to their codewords."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch["v"]).to_numpy()
            for length in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == length))
                points = _matrix(own["v"], length)
                half = length // 2
                codes, away = [], []
                for part, words in zip((points[:, :half], points[:, half:]), indexes[length].words):
                    code = nearest(part, words)
                    codes.append(pa.array(code.astype(np.int32)))
                    away.append(pa.array(np.sqrt(((part - words[code]) ** 2).sum(axis=1))))
                packed = _packed(points)
                step = len(packed) // len(points)
                vectors = pa.array([packed[r * step : (r + 1) * step] for r in range(len(points))], pa.binary())
                dims = pa.array(np.full(len(points), length, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [dims, *codes, *away, own["rid"], own["id"], own["label"], vectors],
                    ["dim", "i", "j", "far_i", "far_j", "rid", "id", "label", "v"],
                )

    schema = "dim int, i int, j int, far_i double, far_j double, rid long, id long, label long, v binary"
    return rows.select("rid", "id", "label", "v").mapInArrow(place, schema)


def build(rows: DataFrame) -> tuple[dict[int, Index], DataFrame, DataFrame]:
    """Index of prepared rows: per vector length its ``Index``, the coded rows, and the blocks."""
    spark = rows.sparkSession
    sizes = {r.dim: r.n for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    indexes = {}
    for dim, n in sizes.items():
        k = max(1, min(CODES, math.isqrt(n // CELL)))
        chosen = rows.where(F.size("v") == dim).orderBy(F.xxhash64("rid"), "rid").limit(min(SAMPLE, PER_CODE * k))
        sample = _matrix(chosen.select("v").toArrow()["v"].combine_chunks(), dim)
        half = dim // 2
        indexes[dim] = Index([codebook(part, k) for part in (sample[:, :half], sample[:, half:])])
    coded = keep(_coded(rows, indexes), "coded")
    cells = coded.groupBy("dim", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("far_i").alias("ri"), F.max("far_j").alias("rj"))
    spots, bundle, held = [], 0, 0  # at most CODES squared cells a length
    for c in sorted(cells.collect(), key=lambda c: (c.dim, c.i, c.j)):
        index = indexes[c.dim]
        index.size[c.i, c.j] = c.n
        index.radii[0][c.i] = max(index.radii[0][c.i], c.ri)
        index.radii[1][c.j] = max(index.radii[1][c.j], c.rj)
        if held and (held + c.n > BLOCK or spots[-1][0] != c.dim):
            bundle, held = bundle + 1, 0
        held += c.n
        index.bundle[c.i, c.j] = bundle
        spots.append((c.dim, c.i, c.j, bundle, max(1, math.ceil(c.n / BLOCK))))
    places = spark.createDataFrame(spots, "dim int, i int, j int, bundle long, blocks int")
    dealt = coded.join(F.broadcast(places), ["dim", "i", "j"])
    salt = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    widths = {dim: index.size.shape[1] for dim, index in indexes.items()}

    def pack(keys, table):
        dim = table["dim"][0].as_py()
        codes = table["i"].to_numpy().astype(np.int64) * widths[dim] + table["j"].to_numpy()
        values = [keys[0].as_py(), keys[1].as_py(), dim, codes.astype("<i8").tobytes()]
        values += [table[n].to_numpy().astype("<i8").tobytes() for n in ("id", "label")]
        values.append(_packed(_rows(table["v"], dim)))
        return pa.table({n: [v] for n, v in zip(out.names, values)}).cast(out)

    out = pa.schema(
        [("bundle", pa.int64()), ("salt", pa.int32()), ("dim", pa.int32())]
        + [(n, pa.binary()) for n in ("codes", "ids", "labels", "points")]
    )
    schema = "bundle long, salt int, dim int, codes binary, ids binary, labels binary, points binary"
    blocks = dealt.withColumn("salt", salt).select("bundle", "salt", "dim", "i", "j", "rid", "id", "label", "v")
    return indexes, coded, keep(blocks.groupBy("bundle", "salt").applyInArrow(pack, schema), "blocks")


#: What an anchor asks for: rows of its own label or of others, of scores from low to high, the best k of them.
SLOTS = "array<struct<slot:int,low:long,high:long>>"
#: An anchor of a batch: ``reach``, the bound above which it visits cells, and so the bound of those it does not visit.
ASK = f"struct<rid:long,id:long,label:long,reach:double,slots:{SLOTS}>"


def _walk(anchors: DataFrame, indexes: dict[int, Index], budget: int | None) -> DataFrame:
    """Kept batches of anchors and the bundles they visit: those of ``budget`` vectors or, without, all that reach a window."""
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast(indexes)
    size = BATCH

    def reached(index: Index, query: np.ndarray, slots: list[dict]) -> tuple[np.ndarray, float]:
        if budget is not None:
            taken, _, left = visits(index, query, 0, budget)
            return np.array(list(taken), np.int64), left
        first, second = index.bounds(query)
        below = first[:, None] + second < min(s["low"] for s in slots)
        return np.unique(index.bundle[(index.size > 0) & ~below]), -math.inf

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                index, at = shared.value[dim], np.flatnonzero(dims == dim)
                for start in range(0, len(at), size):
                    own = batch.take(pa.array(at[start : start + size]))
                    points, slots = _rows(own["v"], dim), own["slots"].to_pylist()
                    met = [reached(index, *q) for q in zip(points, slots)]
                    asks = [
                        dict(zip(("rid", "id", "label", "reach", "slots"), a))
                        for a in zip(*(own[n].to_pylist() for n in ("rid", "id", "label")), (left for _, left in met), slots)
                    ]
                    bundles = np.unique(np.concatenate([b for b, _ in met]))
                    row = {"dim": dim, "bundles": bundles.tolist(), "asks": asks, "queries": _packed(points)}
                    yield pa.RecordBatch.from_pylist([row], out)

    slot = pa.struct([("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
    ask = pa.struct([("rid", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("reach", pa.float64()), ("slots", pa.list_(slot))])
    out = pa.schema([("dim", pa.int32()), ("bundles", pa.list_(pa.int64())), ("asks", pa.list_(ask)), ("queries", pa.binary())])
    order = ["dim", "i", "j", "rid"]  # anchors from near each other visit the same blocks
    dealt = anchors.repartitionByRange(max(1, math.ceil(anchors.count() / size)), *order).sortWithinPartitions(*order)
    walked = dealt.select("rid", "id", "label", "dim", "v", "slots").mapInArrow(
        walk, f"dim int, bundles array<long>, asks array<{ASK}>, queries binary"
    )
    return keep(walked, "visits")


class Windows:
    """The best ``k`` rows found so far for every window of a batch of anchors."""

    def __init__(self, asks: list[dict], queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.ids, self.labels, self.reach = (np.array([a[n] for a in asks]) for n in ("id", "label", "reach"))
        self.rids = np.array([a["rid"] for a in asks], np.int64)
        wide = max(len(a["slots"]) for a in asks)
        #: by anchor and place of the window in its list; a window that is not there takes nothing
        self.slots = np.zeros((len(asks), wide), np.int32)
        self.low, self.high = np.full((len(asks), wide), LONGEST), np.full((len(asks), wide), -LONGEST - 1)
        for r, a in enumerate(asks):
            for c, s in enumerate(a["slots"]):
                self.slots[r, c], self.low[r, c], self.high[r, c] = s["slot"], s["low"], s["high"]
        #: id of the last row wanted, once there are as many: of equal scores only smaller ids are wanted
        self.last = np.full(self.low.shape, LONGEST)
        self.at, self.others, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, index: Index, codes: np.ndarray, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, same_label: bool) -> None:
        """Take the rows of a block that lie in visited cells and in a window."""
        cells, cell = np.unique(codes, return_inverse=True)
        first, second = index.bounds(self.queries, np.divmod(cells, index.size.shape[1]))
        bounds = first + second
        least, most = self.low.min(axis=1), self.high.max(axis=1)
        # not above is not the same as below, should a bound not be a number
        visited = ~(bounds <= self.reach[:, None]) & ~(bounds < least[:, None])
        who = np.flatnonzero(visited.any(axis=1))
        scores = products(self.queries[who], points)
        fits = (scores >= least[who, None]) & (scores <= most[who, None])
        if self.reach.max() > -math.inf:  # else a row that is not in a visited cell is below its windows anyway
            fits &= visited[who][:, cell]
        at = np.flatnonzero(fits)
        for start in range(0, len(at), HANDED):  # all of them where a vector of zeros meets a window at zero
            part = at[start : start + HANDED]
            row, column = who[part // len(ids)], part % len(ids)
            own = ((labels[column] == self.labels[row]) == same_label) & (ids[column] != self.ids[row])
            self._sort(row[own], ids[column[own]], scores.flat[part[own]])

    def _sort(self, row: np.ndarray, others: np.ndarray, scores: np.ndarray) -> None:
        """Rows for anchors into the windows that they lie in."""
        new = []
        for c in range(self.low.shape[1]):
            low = self.low[row, c]
            own = np.flatnonzero((scores <= self.high[row, c]) & ((scores > low) | (scores == low) & (others <= self.last[row, c])))
            new.append((row[own] * self.low.shape[1] + c, others[own], scores[own]))
        if any(len(at) for at, _, _ in new):
            self._take(*(np.concatenate(x) for x in zip((self.at, self.others, self.scores), *new)))

    def _take(self, at: np.ndarray, others: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((others, ~scores, at))
        at = at[order]
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        rank = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
        best = rank < self.k
        self.at, self.others, self.scores = at[best], others[order][best], scores[order][best]
        last = rank == self.k - 1  # what comes after the last one wanted is not wanted
        self.low.flat[at[last]], self.last.flat[at[last]] = scores[order][last], others[order][last]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.at), HANDED):
            part = slice(start, start + HANDED)
            at = self.at[part]
            columns = (self.rids[at // self.low.shape[1]], self.slots.flat[at], self.others[part], self.scores[part])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "slot", "other", "score"])


def _scored(asked: DataFrame, indexes: dict[int, Index], blocks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """Per task, anchor and window the best k rows: ``rid, slot, other, score``."""
    shared = asked.sparkSession.sparkContext.broadcast(indexes)
    # no row of either side is shuffled or repeated on disk: tasks read a part of the blocks and a part of the batches
    met = blocks.drop("salt").join(asked.drop("dim"), F.array_contains("bundles", F.col("bundle"))).drop("bundle", "bundles")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Windows] = {}
        for batch in batches:
            for r, dim in enumerate(batch["dim"].to_pylist()):
                key = batch["asks"][r][0]["rid"].as_py()
                if key not in held:
                    asks = batch["asks"][r].as_py()
                    held[key] = Windows(asks, _unpacked(batch["queries"][r].as_py(), len(asks), dim), k)
                codes, ids, labels = (np.frombuffer(batch[n][r].as_buffer(), "<i8") for n in ("codes", "ids", "labels"))
                points = _unpacked(batch["points"][r].as_buffer(), len(ids), dim)
                held[key].meet(shared.value[dim], codes, ids, labels, points, same_label)
            if sum(w.low.size * k + w.queries.size for w in held.values()) > HELD:
                for windows in held.values():
                    yield from windows.rows()
                held = {}
        for windows in held.values():
            yield from windows.rows()

    return met.mapInArrow(score, "rid long, slot int, other long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), "other")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, indexes: dict[int, Index], blocks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """Kept ``rid, slot, other, score, rank``: the k best rows in each window of each anchor."""
    asked = _walk(anchors, indexes, FIRST)
    best = keep(_best(_scored(asked, indexes, blocks, k, same_label), k), "best")
    # a window is certified when nothing unseen can score as much as its last row, or reach it
    full = best.where(F.col("rank") == k).select("rid", "slot", F.col("score").alias("last"))
    windows = asked.select(F.inline("asks")).where(F.col("reach") > -math.inf).select("rid", "reach", F.inline("slots"))
    unsure = windows.join(full, ["rid", "slot"], "left").where(
        (F.col("reach") >= F.col("low")) & (F.col("last").isNull() | (F.col("reach") >= F.col("last")))
    )
    # they are searched anew, from the score that k rows are known to have
    slots = F.collect_list(F.struct("slot", F.coalesce("last", "low").alias("low"), "high")).alias("slots")
    open_ = keep(anchors.drop("slots").join(unsure.groupBy("rid").agg(slots), "rid"), "open")
    forget(asked)
    if open_.isEmpty():
        return best
    asked = _walk(open_, indexes, None)
    found = _best(_scored(asked, indexes, blocks, k, same_label), k)
    again = open_.select("rid", F.inline("slots")).select("rid", "slot")
    out = keep(best.join(again, ["rid", "slot"], "left_anti").unionByName(found), "found")
    forget(asked, open_, best)
    return out


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """For each anchor and each of its best ``positives``, the best ``negatives`` of other labels in the window.

    The window: ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    ``is_anchor`` is a condition on ``id``. Returns anchor_id, positive_id, positive_rank,
    rank, negative_id, positive_score, negative_score.
    """
    rows = prepare(vectors, id_, embedding, label)
    indexes, coded, blocks = build(rows)
    state = keep(coded.where(is_anchor).select("rid", "id", "label", "dim", "i", "j", "v"), "anchors")
    forget(rows, coded)
    window = lambda slot, a, b: F.struct(slot.cast("int").alias("slot"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    whole = F.array(window(F.lit(0), F.lit(-LONGEST - 1), F.lit(LONGEST)))
    chosen = search(state.withColumn("slots", whole), indexes, blocks, positives, True)
    # 100 s >= low p and 100 s <= high p, in whole numbers: the product with a percentage may need more than 64 bits
    wide = F.col("score").cast("decimal(20,0)")
    least = F.ceil(wide * F.lit(low) / F.lit(100))
    most = F.floor(wide * F.lit(high) / F.lit(100))
    filled = chosen.withColumns({"low": least, "high": most}).where("low <= high")
    asked = filled.groupBy("rid").agg(F.collect_list(window(F.col("rank"), F.col("low"), F.col("high"))).alias("slots"))
    mined = search(state.join(asked, "rid"), indexes, blocks, negatives, False)
    forget(blocks)
    named = state.select("rid", F.col("id").alias("anchor_id"))
    pos = chosen.select("rid", F.col("rank").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.join(pos, ["rid", "slot"]).join(named, "rid")
    return out.select(
        "anchor_id",
        "positive_id",
        F.col("slot").cast("int").alias("positive_rank"),
        F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
