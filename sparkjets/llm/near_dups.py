"""Near duplicates by a chosen-path set-similarity join over word shingles.

Documents with equal shingle sets become one. Every set then walks down random
trees: a node selects a minwise position, and the document goes to the child that
its minwise token there names; similar sets choose the same child as often as they
are similar. After ``DEPTH`` levels the nodes hold few documents. A node is settled
when all its documents are in one component; so first each document is compared
with the leader of its node (a star), links are confirmed on full sets, and only
nodes that still hold several components go on: small ones, and those in which few
documents are outside the main component, compare all pairs of different components;
the others branch once more, with ``PATHS`` paths of ``STEPS`` levels per document so
that similar pairs survive. After that whatever is left is compared in full, so no
document is ever dropped. ``missed`` computes the
chance to miss a pair over all of this: below 1e-5 at just the threshold.

What is compared first are parity sketches: bit i of a sketch says whether an odd
number of shingles hash to i, so two sketches differ in at most as many bits as the
sets differ in shingles. Up to ``SAMPLED`` shingles that bound is exact and no link
is lost; larger sets sketch a sample chosen by hash, at six deviations. A join over a
node counts these bits in its own condition, so pairs that cannot be links never
become rows, however dense their group is.

Nothing here groups the members of a node into one row: nodes, stars, pairs and
components are tables. Documents without words link with nothing; a document of
fewer words than a shingle has all its words as one. Rows with a null id take no
part: their component is null and they are kept. Rows that repeat an id count as one
document, linked with what any of them is linked with.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.llm.common import forget, keep, once, text_key

POSITIONS = 96
DEPTH = 4
TREES = POSITIONS // DEPTH
#: Nodes up to this size compare all their pairs, and so do larger ones of so few documents outside the main component.
SMALL = 48
STRAYS = 1024
#: Documents of a node that one task compares with those outside the main component.
BLOCK = 8192
#: Rounds of further branching, and the paths and their levels in each.
LEVELS = 1
PATHS = 5
STEPS = 2
#: Bits of a parity sketch, the most shingles that one is made of, and the deviations allowed where these are a sample.
BITS = 1024
SAMPLED = 512
DEVIATIONS = 6

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)[:, None]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a text."""
    if not text:
        return np.empty(0, np.uint64)
    found = WORDS.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(once("word hashes", _Hashes).__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    n = len(found) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += _mixed(hashed[k : k + n]) * _FACTORS[k]
    return np.unique(_mixed(total))


def signature(of: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set at all positions."""
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(of), 2048):
        part = (_A * of[None, i : i + 2048] + _B) >> np.uint64(32)
        np.minimum(out, part.min(axis=1), out=out)
    return out.astype("<u4")


def sample_level(n: int) -> int:
    """A set of ``n`` shingles is sketched from one shingle in ``2 ** level``."""
    return max(0, (max(n, 1) - 1) // SAMPLED).bit_length()


def sketch(of: np.ndarray, level: int) -> np.ndarray:
    """Parities of the shingles of a set that a sample of one in ``2 ** level`` holds, as 64-bit words."""
    chosen = of[(of & np.uint64((1 << level) - 1)) == 0]
    places = ((chosen >> np.uint64(40)) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def similar_sizes(n_p: str, n_q: str, threshold: int) -> Column:
    return 100 * F.least(n_p, n_q) >= threshold * F.greatest(n_p, n_q)


def may_link(p: str, q: str, threshold: int) -> Column:
    """False only for pairs that are no links (beyond ``SAMPLED`` shingles: that are none at ``DEVIATIONS`` deviations).

    ``p`` and ``q`` end the names of the columns n, level, x and y of either side: size, level of the sample, the
    sketch at that level and the one at the next. Sets of similar sizes are at most one level apart.
    """
    level = f"greatest(level_{p}, level_{q})"
    own, other = (f"IF(level_{a} >= level_{b}, x_{a}, y_{a})" for a, b in ((p, q), (q, p)))
    apart = " + ".join(f"bit_count({own}[{i}] ^ {other}[{i}])" for i in range(BITS // 64))
    # 100 * |A & B| >= threshold * |A | B| is |A ^ B| <= (|A| + |B|) * (100 - threshold) / (100 + threshold)
    most = f"((n_{p} + n_{q}) * {100 - threshold} / {100 + threshold} / pow(2, {level}))"
    sampled = f"{BITS / 2}D * (1 - exp(-{most} / {BITS / 2}D)) + {DEVIATIONS} * sqrt({most}) + 1"
    return F.expr(f"{apart} <= IF({level} = 0, {most}, {sampled})")


def describe(docs: DataFrame, words: int) -> DataFrame:
    """Kept ``doc_id, n_shingles, f1, f2`` (fingerprint of the set), ``sig``, and the sketches ``level, x, y``.

    ``y``, the sketch at the next level, is null where no set of a similar size has that level.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, signatures, levels, here, next_ = [], [], [], [], [], [], []
            for text in batch["text"]:
                own = shingles(text.as_py(), words)
                sizes.append(len(own))
                marks = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                first.append(int(marks[0]))
                second.append(int(marks[1]))
                signatures.append(signature(own).tobytes() if len(own) else None)
                levels.append(level := sample_level(len(own)))
                here.append(sketch(own, level) if len(own) else None)
                next_.append(sketch(own, level + 1) if sample_level(2 * len(own)) > level else None)
            arrays = [pa.array(sizes, pa.int64()), pa.array(first), pa.array(second), pa.array(signatures, pa.binary())]
            arrays += [pa.array(levels, pa.int32()), pa.array(here, pa.list_(pa.int64())), pa.array(next_, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", "n_shingles", "f1", "f2", "sig", "level", "x", "y"])

    schema = "doc_id long, n_shingles long, f1 long, f2 long, sig binary, level int, x array<long>, y array<long>"
    return keep(docs.select("doc_id", "text").mapInArrow(features, schema), "sets")


def _children(node: np.ndarray, position: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Child nodes: the path so far, and the minwise token at the selected position of each row."""
    token = sig[np.arange(len(node)), position].astype(np.uint64)
    return _mixed(node * np.uint64(0x9E3779B97F4A7C15) + token * _FACTORS[40] + position.astype(np.uint64))


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(s.as_buffer() for s in column), "<u4").reshape(-1, POSITIONS)


NODES = "node long, d long, n long"


def roots_down(sets: DataFrame) -> DataFrame:
    """Nodes of every tree after ``DEPTH`` levels, one row per document and tree: ``node, d, n``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, rows = _signatures(batch["sig"]), batch.num_rows
            nodes = []
            for tree in range(TREES):
                node = np.full(rows, tree + 1, np.uint64)
                for level in range(DEPTH):  # trees select different positions, so they are independent
                    node = _children(node, np.full(rows, tree * DEPTH + level), sig)
                nodes.append(node.view(np.int64))
            d, n = batch["d"].to_numpy(), batch["n"].to_numpy()
            arrays = [pa.array(np.concatenate(nodes)), pa.array(np.tile(d, TREES)), pa.array(np.tile(n, TREES))]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "d", "n"])

    return sets.select("d", "n", "sig").mapInArrow(walk, NODES)


def branch(rows: DataFrame) -> DataFrame:
    """``PATHS`` independent paths of ``STEPS`` levels further down; the node and the path select the positions.

    ``rows``: node, d, n, sig.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, top = _signatures(batch["sig"]), batch["node"].to_numpy().view(np.uint64)
            for path in range(PATHS):
                node = _mixed(top + np.uint64(path + 1) * _FACTORS[41])
                for _ in range(STEPS):
                    # a hash of the child says the next position, so that it hangs on nothing but the path
                    position = (_mixed(node ^ _FACTORS[42]) >> np.uint64(20)) % np.uint64(POSITIONS)
                    node = _children(node, position.astype(np.int64), sig)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch["d"], batch["n"]], ["node", "d", "n"])

    return rows.select("node", "d", "n", "sig").mapInArrow(walk, NODES)


def missed(similarity: float) -> float:
    """The chance that a pair of large nodes meets in no compared node.

    Summed over the number k of equal minwise tokens; given k, a path from a shared
    node keeps the pair with ``(k / POSITIONS) ** STEPS``. What stars find is not counted.
    """
    total = 0.0
    for k in range(POSITIONS + 1):
        lost = 1 - (1 - (1 - (k / POSITIONS) ** STEPS) ** PATHS) ** LEVELS
        tree = [float(math.comb(DEPTH, j)) for j in range(DEPTH)] + [lost]
        all_trees = np.ones(1)
        for _ in range(TREES):
            all_trees = np.convolve(all_trees, tree)
        total += float(all_trees[k]) * similarity**k * (1 - similarity) ** (POSITIONS - k)
    return total


SKETCHED = ["d", "n", "level", "x", "y"]


def _side(rows: DataFrame, end: str, *others: str) -> DataFrame:
    """Columns of one side of a comparison, with names that end in ``end``."""
    return rows.select(*others, *(F.col(c).alias(f"{c}_{end}") for c in SKETCHED))


def _alike(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose sketches are close enough for a look at the full sets."""
    both = pairs.join(_side(sets, "p"), F.col("a") == F.col("d_p")).join(
        _side(sets, "q"), (F.col("b") == F.col("d_q")) & similar_sizes("n_p", "n_q", threshold) & may_link("p", "q", threshold)
    )
    return both.select("a", "b")


def _split(placed: DataFrame) -> DataFrame:
    """Nodes of several components: ``node, main`` (the component of the leader) and ``strays``, the documents outside it."""
    parts = placed.groupBy("node", "root").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("d") == F.col("a")).alias("led"))
    main, strays = F.max(F.when(F.col("led"), F.col("root"))), F.sum(F.when(~F.col("led"), F.col("rows")))
    return parts.groupBy("node").agg(main.alias("main"), strays.alias("strays")).where("strays > 0")


def _with_earlier(rows: DataFrame) -> DataFrame:
    """``rows`` (node, d, a) with ``earlier``: the nodes before this one in which the document is not the leader."""
    nodes = Window.partitionBy("d").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("earlier", F.collect_list(F.when(F.col("d") != F.col("a"), F.col("node"))).over(nodes))


def _pairs_of(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that share a node; each comes out of its first common node only.

    ``rows``: node, size, a (its leader), main (the component of the leader), root, earlier, SKETCHED. Documents outside
    the main component meet all others, those inside never each other; a node is dealt in blocks of ``BLOCK`` documents.
    Pairs with a leader were looked at before. Only where rows repeat an id can a pair come twice.
    """
    blocks = F.ceil(F.col("size") / BLOCK)
    strays = rows.where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    one = _side(strays, "p", "node", "block", F.col("root").alias("r_p"), F.col("earlier").alias("e_p"))
    dealt = rows.where(F.col("d") != F.col("a")).withColumn("block", F.pmod(F.xxhash64("d"), blocks))
    own = [F.col(c).alias(f"{c}_q") for c in ("node", "block", "main")]
    two = _side(dealt, "q", *own, F.col("root").alias("r_q"), F.col("earlier").alias("e_q"))
    same = (F.col("node") == F.col("node_q")) & (F.col("block") == F.col("block_q"))
    other = (F.col("r_p") != F.col("r_q")) & ((F.col("r_q") == F.col("main_q")) | (F.col("d_p") < F.col("d_q")))
    near = similar_sizes("n_p", "n_q", threshold) & may_link("p", "q", threshold)
    pairs = one.join(two, same & other & near & ~F.arrays_overlap("e_p", "e_q"))
    return pairs.select(F.least("d_p", "d_q").alias("a"), F.greatest("d_p", "d_q").alias("b"))


def confirm(pairs: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Pairs (a, b) with ``100 * |A & B| >= threshold * |A | B|`` on the full sets.

    Only documents of some pair are cut into shingles again; each pair brings two
    sets together, a document's set goes no further than its pairs.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words).tobytes() for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.binary())], ["d", "set"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                close.append(both > 0 and 100 * both >= threshold * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = keep(texts.mapInArrow(cut, "d long, set binary").distinct(), "full-sets")
    first = pairs.join(sets.select(F.col("d").alias("b"), F.col("set").alias("set_b")), "b")
    both = first.join(sets.select(F.col("d").alias("a"), F.col("set").alias("set_a")), "a")
    found = keep(both.select("a", "b", "set_a", "set_b").mapInArrow(count, "a long, b long").distinct(), "links")
    forget(sets)
    return found


def components(edges: DataFrame) -> DataFrame:
    """``d, root``: the smallest id that each id of an edge (a, b) reaches, by alternating large and small stars.

    Every pass shortens all chains at once, so the number of passes grows with the
    logarithm of the longest; each pass is written, so none is computed twice.
    """

    def ordered(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    now = keep(ordered(edges), "stars")
    seen = mark(now)
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b")
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a")
        flat = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = keep(ordered(flat.select("e.a", "e.b")), "stars")
        mark_after = mark(after)
        forget(now)
        if mark_after == seen:
            found = after.select(F.col("a").alias("d"), F.col("b").alias("root"))
            found._kept_at = after._kept_at
            return found
        now, seen = after, mark_after


def _with_leaders(nodes: DataFrame) -> DataFrame:
    """Kept rows of nodes with two documents or more: ``node, d, n, size``, and the leader ``a, n_a`` of each node.

    The leader is the document whose nodes hold the most documents over all trees:
    the text that a group of near copies was made from shares more nodes with them
    than they do with each other.
    """
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = keep(nodes.join(sizes, "node"), "shared-nodes")
    weighted = shared.withColumn("w", F.sum("size").over(Window.partitionBy("d")))
    best = weighted.groupBy("node").agg(F.max(F.struct("w", (-F.col("d")).alias("minus"), "n")).alias("best"))
    led = best.select("node", (-F.col("best.minus")).alias("a"), F.col("best.n").alias("n_a"))
    crowded = keep(shared.join(led, "node"), "crowded")
    forget(shared)
    return crowded


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links) and kept.

    ``threshold`` is at least 50, so that sizes of linked sets are at most one sample level apart.
    """
    if threshold < 50:
        raise ValueError("sketches compare sets of similarity 0.5 or more")
    described = describe(docs, words)
    known = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets become one, the smallest id stands for them
    marks = F.first(F.struct(F.col("n_shingles").alias("n"), "sig", "level", "x", "y")).alias("of")
    merged = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("d"), marks)
    sets = keep(merged.select("f1", "f2", "d", "of.*"), "distinct-sets")
    nodes = keep(roots_down(sets), "nodes")
    roots = sets.sparkSession.createDataFrame([], "d long, root long")
    pending: list[DataFrame] = []

    def look_at(pairs: DataFrame) -> None:
        candidates = keep(pairs, "pairs")
        if not candidates.isEmpty():
            pending.append(confirm(candidates, docs, words, threshold))
        forget(candidates)

    def settle(roots: DataFrame) -> DataFrame:
        """Components with the links found since the last time; what was known is one edge per document."""
        news = [df for df in pending if not df.isEmpty()]
        edges = roots.select(F.col("d").alias("a"), F.col("root").alias("b"))
        for new in news:
            edges = edges.unionByName(new)
        settled = components(edges) if news else roots
        forget(*pending)
        if news:
            forget(roots)
        pending.clear()
        return settled

    for level in range(LEVELS + 1):
        crowded = _with_leaders(nodes)
        forget(nodes)
        near = similar_sizes("n", "n_a", threshold) & (F.col("d") != F.col("a"))
        stars = crowded.where(near).select("a", F.col("d").alias("b")).distinct()
        if level:  # links that are known need no second look
            stars = stars.join(roots.select(F.col("d").alias("a"), F.col("root").alias("ra")), "a", "left").join(
                roots.select(F.col("d").alias("b"), F.col("root").alias("rb")), "b", "left"
            ).where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        look_at(_alike(stars, sets, threshold))
        roots = settle(roots)
        placed = crowded.join(roots, "d", "left").withColumn("root", F.coalesce("root", "d"))
        open_ = keep(placed.join(_split(placed), "node"), "open")
        forget(crowded)
        in_full = (F.col("size") <= SMALL) | (F.col("strays") <= STRAYS)
        small = open_ if level == LEVELS else open_.where(in_full)
        placed_in = _with_earlier(small.select("node", "size", "a", "main", "root", "d"))
        look_at(_pairs_of(placed_in.join(sets.select(*SKETCHED), "d"), threshold).distinct())
        if level == LEVELS:
            forget(open_)
            break
        large = open_.where(~in_full)
        if large.isEmpty():
            forget(open_)
            break
        # a document of a large node needs its signature again
        nodes = keep(branch(large.select("node", "d", "n").join(sets.select("d", "sig"), "d")).distinct(), "nodes")
        forget(open_)

    rows = described.select("doc_id", "n_shingles", "f1", "f2").join(sets.select("f1", "f2", "d"), ["f1", "f2"], "left")
    # rows of one id with different sets: whatever these are linked with is linked
    twice = rows.where("d IS NOT NULL").join(
        rows.where("d IS NOT NULL").groupBy("doc_id").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x < y"), "doc_id"
    ).select(F.col("doc_id").alias("a"), F.col("d").alias("b"))
    pending.append(twice)
    roots = settle(roots)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "d", "doc_id"))
    found = rows.join(roots, "d", "left").withColumn("component_id", component)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_each(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the one of the smallest id.

    Where rows repeat an id, each row is judged by its own text: rows of one id that hold
    different texts are no duplicates of each other, equal rows are (ties go by a hash of the text).
    Rows without words link with nothing and stay, as do all rows with a null id.
    """
    named = docs.where("doc_id IS NOT NULL")
    nameless = docs.where("doc_id IS NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(named, words, threshold).where("kept").select("doc_id")
        return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(nameless)
    # numbers of rows, written once, so that a retried task sees the same ones
    rows = keep(named.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    numbers = rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))
    placed = near_duplicates(numbers, words, threshold).select(F.col("doc_id").alias("number"), "component_id")
    order = F.struct(F.col("row.doc_id").alias("id"), text_key("row.text").alias("text_hash"), "number")
    least = rows.select("number", order.alias("order")).join(placed, "number").groupBy("component_id").agg(F.min("order").alias("order"))
    chosen = rows.join(least.select(F.col("order.number").alias("number")), "number", "left_semi").select("row.*")
    return chosen.unionByName(nameless)
