"""Exact top-k search by inner product with cover trees over queries and candidates.

Vectors are dealt into blocks: by the nearest of a bounded, sampled set of pivots
(neighbours meet in a block) and, where a pivot attracts many, by a hash. Every
block of candidates and every group of queries becomes a cover tree, built once and
kept with the block: a node is a
centre with a covering radius, its children are centres at least half that radius
apart, each covering what lies within half of it. Two trees are walked together. A
pair of nodes can give no product above

    <q, c> + rq |c| + rc |q| + rq rc

(q, c: centres, rq, rc: radii); it is dropped when that is below the worst k-th score
of its query group. Pairs of leaves are multiplied in full.

The walk takes two rounds. First every query group meets the block of its own
pivot, which gives its k-th scores; then it meets those blocks whose root can still
beat them. Only those pairs are shuffled, and each returns at most k rows per
query. Bounds are widened by a relative 1e-9, so rounding never drops a pair, and
scores are sums of integers below 2^53, so they are exact.

Components are floor(1024 * x). Vectors that are null, or hold a null or a component
that is not finite or beyond 2^31 after scaling, take no part, nor do rows with a
null id. Of rows that repeat an id the smallest vector is taken. Vectors of
different lengths never meet. Ties go to smaller ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.llm.common import keep

SCALE = 1024
#: Vectors of a block, and of a query group, at most on average; more blocks come with more vectors.
BLOCK, GROUP = 8192, 512
#: Pivots at most: one per so many blocks' worth of vectors, sampled by a hash of the id.
PIVOTS = 256
#: A node with no more points is a leaf.
LEAF = 32


class Tree:
    """Cover tree as arrays: nodes in depth-first order, points of a node are a slice of ``order``."""

    def __init__(self, points: np.ndarray, saved: bytes | None = None):
        self.points = points
        self.order = np.arange(len(points))
        self.first: list[int] = []
        self.stop: list[int] = []
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        if saved is not None:
            self._restore(saved)
        elif len(points):
            own = self.order.copy()
            self._grow(own, 0, self._nearest_to_mean(), None)
        self.centre_points = points[self.centre] if len(points) else points
        self.norm = np.sqrt((self.centre_points**2).sum(axis=1))
        self.reach = np.array(self.radius)
        self.ordered = points[self.order]

    def save(self) -> bytes:
        """The shape of the tree without its points: per node its slice, centre, parent and radius."""
        parent = np.full(len(self.first), -1, np.int64)
        for node, children in enumerate(self.children):
            parent[children] = node
        shape = np.array([self.first, self.stop, self.centre, parent], "<i8").reshape(4, -1)
        return self.order.astype("<i8").tobytes() + shape.tobytes() + np.array(self.radius, "<f8").tobytes()

    def _restore(self, saved: bytes) -> None:
        n = len(self.points)
        self.order = np.frombuffer(saved, "<i8", n)
        nodes = (len(saved) // 8 - n) // 5
        shape = np.frombuffer(saved, "<i8", 4 * nodes, 8 * n).reshape(4, nodes)
        self.first, self.stop, self.centre, parent = (row.tolist() for row in shape)
        self.radius = np.frombuffer(saved, "<f8", nodes, 8 * (n + 4 * nodes)).tolist()
        self.children = [[] for _ in range(nodes)]
        for node, above in enumerate(parent):
            if above >= 0:
                self.children[above].append(node)

    def _nearest_to_mean(self) -> int:
        away = self.points - self.points.mean(axis=0)
        return int((away**2).sum(axis=1).argmin())

    def _distance(self, members: np.ndarray, centre: int) -> np.ndarray:
        away = self.points[members] - self.points[centre]
        return np.sqrt((away**2).sum(axis=1))

    def _grow(self, members: np.ndarray, at: int, centre: int, away: np.ndarray | None) -> int:
        """Add the node of ``members`` (placed from ``at`` on); iterative, deepest chains are no recursion limit."""
        root = len(self.first)
        todo = [(members, at, centre, away, -1)]
        while todo:
            members, at, centre, away, parent = todo.pop()
            away = self._distance(members, centre) if away is None else away
            node = len(self.first)
            radius = float(away.max())
            self.first.append(at)
            self.stop.append(at + len(members))
            self.centre.append(centre)
            self.radius.append(radius)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            self.order[at : at + len(members)] = members
            if len(members) <= LEAF or radius == 0.0:
                continue
            half, left, left_away, new = radius / 2, members, away, centre
            loose, parts = [], []
            while len(left):
                near = left_away <= half
                own, own_away = left[near], left_away[near]
                left = left[~near]
                # a lone point needs no node of its own: such points stay together as leaves
                if len(own) <= 2:
                    loose.append(own)
                else:
                    parts.append((own, new, own_away))
                if len(left):
                    new = int(left[0])
                    left_away = self._distance(left, new)
            for i, own in enumerate(_bundles(loose)):
                parts.append((own, int(own[0]), None))
            if len(parts) == 1 and len(parts[0][0]) == len(members):
                continue  # nothing was split: a large leaf
            for own, new, own_away in parts:
                todo.append((own, at, new, own_away, node))
                at += len(own)
        return root


def _bundles(loose: list[np.ndarray]) -> list[np.ndarray]:
    """Lone points in bundles of at most ``LEAF``."""
    if not loose:
        return []
    points = np.concatenate(loose)
    return [points[i : i + LEAF] for i in range(0, len(points), LEAF)]


class Best:
    """The k best (score, id) of each query so far; equal scores go to smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = [np.empty(0, np.int64) for _ in range(n)]
        self.id = [np.empty(0, np.int64) for _ in range(n)]
        self.worst = np.full(n, -np.inf) if floor is None else floor.astype(float)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[query], scores])
        id_ = np.concatenate([self.id[query], ids])
        if len(score) > self.k:
            edge = np.partition(score, len(score) - self.k)[len(score) - self.k]
            chosen = np.flatnonzero(score >= edge)
            score, id_ = score[chosen], id_[chosen]
        best = np.lexsort((id_, -score))[: self.k]
        self.score[query], self.id[query] = score[best], id_[best]
        if len(best) == self.k:
            self.worst[query] = max(self.worst[query], float(score[best[-1]]))


def bound(q, q_norm, q_radius, c, c_norm, c_radius):
    """No product of a point near ``q`` and one near ``c`` is greater."""
    top = q @ c.T + q_radius * c_norm + c_radius * q_norm + q_radius * c_radius
    return top + 1e-9 * (np.abs(q) @ np.abs(c.T) + q_radius * c_norm + c_radius * q_norm + q_radius * c_radius) + 1e-6


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: in doubles where these are exact, else in 64-bit integers."""
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    return a @ b.T if most < 1 << 53 else a.astype(np.int64) @ b.astype(np.int64).T


def dual_search(queries: Tree, query_ids: np.ndarray, block: Tree, ids: np.ndarray, best: Best) -> int:
    """Walk both trees, most promising pairs first; returns the number of products."""
    done = 0
    todo = [(math.inf, 0, 0)]
    while todo:
        top, u, v = todo.pop()
        members = queries.order[queries.first[u] : queries.stop[u]]
        if top < best.worst[members].min():
            continue
        down_u, down_v = queries.children[u], block.children[v]
        if not down_u and not down_v:
            of_block = block.order[block.first[v] : block.stop[v]]
            chosen = members[best.worst[members] <= top]
            scores = product(queries.points[chosen], block.ordered[block.first[v] : block.stop[v]])
            done += scores.size
            for query, row in zip(chosen, scores):
                fits = np.flatnonzero((row >= best.worst[query]) & (ids[of_block] != query_ids[query]))
                if len(fits):
                    best.offer(int(query), row[fits].astype(np.int64), ids[of_block[fits]])
            continue
        # go down in the wider of the two
        if down_v and (not down_u or block.reach[v] >= queries.reach[u]):
            tops = bound(
                queries.centre_points[u], queries.norm[u], queries.reach[u],
                block.centre_points[down_v], block.norm[down_v], block.reach[down_v],
            )
            pairs = [(float(t), u, w) for t, w in zip(tops, down_v)]
        else:
            tops = bound(
                block.centre_points[v], block.norm[v], block.reach[v],
                queries.centre_points[down_u], queries.norm[down_u], queries.reach[down_u],
            )
            pairs = [(float(t), w, v) for t, w in zip(tops, down_u)]
        todo += sorted(pairs)
    return done


def _quantised(column: str) -> Column:
    """floor(1024 * x) of every component, or null for a vector that takes no part."""
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))
    ok = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float(1 << 31) / SCALE)))
    return F.when(ok, scaled)


def prepare(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, v`` (array of longs) of the vectors that take part, one row per id."""
    rows = vectors.select(F.col(id_).cast("long").alias("id"), _quantised(embedding).alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    length = len(column[0]) if len(column) else 0
    return column.values.to_numpy(zero_copy_only=False)[: len(column) * length].reshape(len(column), length).astype(float)


def _assign(rows: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``rows`` with the length of the vector and its nearest pivot."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch["v"]], np.int64)
            found = np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                centres = pivots.get(int(length))
                if centres is not None and length:
                    points = _matrix(batch["v"].take(pa.array(at)))
                    found[at] = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
            arrays = [batch["id"], batch["v"], pa.array(lengths.astype(np.int32)), pa.array(found.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "v", "dim", "pivot"])

    return rows.mapInArrow(nearest, "id long, v array<long>, dim int, pivot int")


def _pack(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per block of at most about ``BLOCK`` vectors: its ids, its vectors and its root's ball."""

    def pack(keys, table):
        ids = table["id"].combine_chunks().to_numpy()
        points = _matrix(table["v"].combine_chunks())
        tree = Tree(points)
        values = [*(k.as_py() for k in keys), len(ids), ids.astype("<i8").tobytes(), points.astype("<i8").tobytes()]
        values += [tree.save(), tree.centre_points[0].tolist(), float(tree.norm[0]), float(tree.reach[0])]
        names = [*key, "n", "ids", "points", "tree", "centre", "norm", "radius"]
        return pa.table({name: [value] for name, value in zip(names, values)}).cast(out)

    out = pa.schema(
        [(k, pa.int32()) for k in key] + [("n", pa.int64()), ("ids", pa.binary()), ("points", pa.binary()), ("tree", pa.binary())]
        + [("centre", pa.list_(pa.float64())), ("norm", pa.float64()), ("radius", pa.float64())]
    )
    schema = ", ".join(f"{k} int" for k in key) + ", n long, ids binary, points binary, tree binary, centre array<double>, norm double, radius double"
    return rows.groupBy(*key).applyInArrow(pack, schema)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Dual walks of the packed pairs; ``floor`` holds the k-th scores that the queries of a group have already."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = (np.frombuffer(row[n], "<i8") for n in ("ids", "q_ids"))
                dim = row["dim"]
                block = Tree(np.frombuffer(row["points"], "<i8").reshape(len(ids), dim).astype(float), row["tree"])
                queries = Tree(np.frombuffer(row["q_points"], "<i8").reshape(len(query_ids), dim).astype(float), row["q_tree"])
                known = {f["id"]: f["score"] for f in row["floor"] or ()}
                floor = np.array([known.get(q, -np.inf) for q in query_ids.tolist()], float)
                best = Best(len(query_ids), k, floor)
                dual_search(queries, query_ids, block, ids, best)
                found = [len(s) for s in best.score]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, found)),
                        pa.array(np.concatenate(best.id)),
                        pa.array(np.concatenate(best.score)),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    needed = pairs.select("dim", "ids", "points", "tree", "q_ids", "q_points", "q_tree", "floor")
    return needed.mapInArrow(walk, "query_id long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query; at most k rows of it come from each pair of blocks."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k highest inner products with other vectors.

    ``is_query`` is a condition on ``id``.
    """
    rows = keep(prepare(vectors, id_, embedding), "vectors")
    sizes = {r.dim: r.n for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        wanted = min(PIVOTS, math.ceil(n / BLOCK))
        sample = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
        pivots[dim] = np.array([r.v for r in sample], float).reshape(len(sample), dim)
    placed = keep(_assign(rows, pivots), "placed")
    # a pivot that attracts many vectors has many blocks
    counts = placed.groupBy("dim", "pivot").agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("nq")
    ).collect()
    literal = lambda part: F.create_map(*(F.lit(x) for r in counts for x in (f"{r.dim}/{r.pivot}", part(r))))
    name = F.concat_ws("/", "dim", "pivot")
    blocks_of = lambda size: F.pmod(F.xxhash64("id"), F.try_element_at(size, name)).cast("int")
    if not counts:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    many = literal(lambda r: math.ceil(r.n / BLOCK))
    few = literal(lambda r: max(1, math.ceil((r.nq or 0) / GROUP)))
    blocks = keep(_pack(placed.withColumn("salt", blocks_of(many)), ["dim", "pivot", "salt"]), "blocks")
    groups = keep(_pack(placed.where(is_query).withColumn("salt", blocks_of(few)), ["dim", "pivot", "salt"]), "groups")
    q = groups.select("dim", F.col("pivot").alias("q_pivot"), F.col("salt").alias("q_salt"), F.col("ids").alias("q_ids"), F.col("points").alias("q_points"), F.col("tree").alias("q_tree"), F.col("centre").alias("q_centre"), F.col("norm").alias("q_norm"), F.col("radius").alias("q_radius"))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    # round one: one block of the query group's own pivot
    at_home = q.join(
        blocks, (blocks.dim == q.dim) & (blocks.pivot == q.q_pivot) & (blocks.salt == F.lit(0))
    ).drop(q.dim).withColumn("floor", none)
    first = keep(_search(at_home, k), "first-round")
    reached = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    # k-th scores go back to their group, at most GROUP of them on average
    member = placed.where(is_query).withColumn("q_salt", blocks_of(few)).select("id", "dim", F.col("pivot").alias("q_pivot"), "q_salt")
    floors = member.join(reached, "id", "left").groupBy("dim", "q_pivot", "q_salt").agg(
        F.collect_list(F.when(F.col("score").isNotNull(), F.struct("id", "score"))).alias("floor"),
        F.min(F.coalesce("score", F.lit(-(1 << 62)))).alias("worst"),
    )
    # round two: a pair of roots that can beat the group's worst k-th score; only their balls are compared
    heads = q.select("dim", "q_pivot", "q_salt", "q_centre", "q_norm", "q_radius").join(floors, ["dim", "q_pivot", "q_salt"])
    balls = blocks.select("dim", "pivot", "salt", "centre", "norm", "radius")
    product = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    slack = F.col("q_radius") * F.col("norm") + F.col("radius") * F.col("q_norm") + F.col("q_radius") * F.col("radius")
    size = F.col("q_norm") * F.col("norm") + slack
    rest = (F.col("pivot") != F.col("q_pivot")) | (F.col("salt") != 0)
    open_ = heads.join(balls, "dim").where(rest & (product + slack + size * 1e-9 + 1e-6 >= F.col("worst")))
    chosen = open_.select("dim", "q_pivot", "q_salt", "pivot", "salt", "floor")
    full = chosen.join(blocks.select("dim", "pivot", "salt", "ids", "points", "tree"), ["dim", "pivot", "salt"]).join(
        q.select("dim", "q_pivot", "q_salt", "q_ids", "q_points", "q_tree"), ["dim", "q_pivot", "q_salt"]
    )
    second = _search(full.repartition("q_pivot", "q_salt", "pivot", "salt"), k)
    result = _best(first.unionByName(second), k)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
