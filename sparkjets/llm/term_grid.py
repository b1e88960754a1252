"""Ranked lexical search over a term-document grid held in k2-treaps.

The grid has a row per term and a column per document; a cell holds the impact of the
term there, its whole contribution to a score. Documents are cut into shards of bounded
size, and each shard's part of the grid becomes a k2-treap: a quadtree (k = 2) of which
only occupied cells exist, four bits per cell say which quarters do, and every cell
stores the greatest impact below it, as the difference from its parent's.

An item is a set of rows. Its row paths go down the tree together: a state is a range of
documents with, for every row that still has something there, the quadtree cell of that
row and range. The sum of these cells' maxima bounds every score in the range. States
are taken best first, ``TOGETHER`` at once, halved, and dropped when their bound is below
the item's k-th score; a range of one document has its exact score as its bound.

On Spark: one pass counts terms per document (only terms that some item holds are
written), a small aggregate gives document frequencies, every task builds the treaps of
its own documents, without a shuffle. The search takes a sixteenth of the shards first;
the k-th scores found there are sent to the search of the rest, so that a task returns
hardly more than what can still enter a result. Items come in blocks of bounded
vocabulary, all documents are searched for each.

Only A-Z are lower-cased; a null text has no terms. Rows with a null id take no part,
nor in any count. Rows that repeat an id are documents of their own, each with its own
rank. Every row of ``items`` is an item of its own; a null text finds nothing. Equal
scores go by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.llm.common import forget, keep

#: Distinct terms of a block of items on average; a block's vocabulary and impacts go to every worker.
VOCABULARY = 200_000
#: A shard ends with the document that fills either.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 18
#: Ranges that are halved at once.
TOGETHER = 512
#: One shard of so many is searched first.
FIRST = 16
#: Letters, digits and everything that is not ASCII, once A-Z are lower-cased; other bytes part terms.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BITS = np.array([bin(mask).count("1") for mask in range(16)], np.int64)
#: Children of a cell before its quarter ``q``.
_BEFORE = np.array([[bin(mask & ((1 << q) - 1)).count("1") for q in range(4)] for mask in range(16)], np.int32)


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def interleaved(x: np.ndarray) -> np.ndarray:
    """The bits of ``x`` (below 2^31) at every other place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """k2-treap over (row, column, impact): arrays over all cells, level by level from the root."""

    def __init__(self, height: int, mask: np.ndarray, value: np.ndarray, ids: np.ndarray):
        self.height, self.mask, self.value, self.ids = height, mask, value, ids
        #: the first child of every cell: the cells of a level are in the order of their parents
        self.first = np.cumsum(_BITS[mask], dtype=np.int64) - _BITS[mask] + 1

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, ids: np.ndarray) -> Treap:
        """At least one posting; no two in one cell."""
        height = max(1, int(max(rows.max(), len(ids) - 1)).bit_length())
        code = (interleaved(rows) << np.uint64(1)) | interleaved(columns)
        order = np.argsort(code, kind="stable")
        code, value = code[order], impacts[order].astype(np.int64)
        masks, values = [np.zeros(len(code), np.uint8)], [value]
        for _ in range(height):
            above = code >> np.uint64(2)
            start = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            quarter = (np.uint8(1) << (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            masks.append(np.bitwise_or.reduceat(quarter, start))
            values.append(np.maximum.reduceat(value, start))
            code, value = above[start], values[-1]
        return cls(height, np.concatenate(masks[::-1]), np.concatenate(values[::-1]), ids)

    def _parents(self) -> np.ndarray:
        """The parent of every cell but the root."""
        return np.repeat(np.arange(len(self.mask)), _BITS[self.mask])

    def save(self) -> dict[str, bytes | int]:
        """Two cells' masks to a byte; maxima as differences from the parent's, each in the fewest bytes that hold all."""
        below = self.value[self._parents()] - self.value[1:]
        width = next(w for w in (1, 2, 4, 8) if int(below.max(initial=0)) < 1 << (8 * w - 1))
        half = np.concatenate([self.mask, np.zeros(len(self.mask) % 2, np.uint8)])
        return {
            "height": self.height,
            "cells": len(self.mask),
            "top": int(self.value[0]),
            "masks": (half[::2] | half[1::2] << 4).tobytes(),
            "width": width,
            "differences": below.astype(f"<i{width}").tobytes(),
            "ids": self.ids.astype("<i8").tobytes(),
        }

    @classmethod
    def load(cls, saved: dict) -> Treap:
        packed = np.frombuffer(saved["masks"], np.uint8)
        mask = np.stack([packed & 15, packed >> 4], axis=1).reshape(-1)[: saved["cells"]]
        tree = cls(saved["height"], mask, np.empty(0, np.int64), np.frombuffer(saved["ids"], "<i8"))
        below = np.frombuffer(saved["differences"], f"<i{saved['width']}").astype(np.int64)
        value = np.empty(len(mask), np.int64)
        value[0] = saved["top"]
        at, count = 0, 1  # a level after the other: its cells' parents are known by then
        while at + count < len(mask):
            children = int(_BITS[mask[at : at + count]].sum())
            parents = np.repeat(np.arange(at, at + count), _BITS[mask[at : at + count]])
            down = slice(at + count, at + count + children)
            value[down] = value[parents] - below[at + count - 1 : at + count - 1 + children]
            at, count = at + count, children
        tree.value = value
        return tree

    def search(self, rows: np.ndarray, best: Best) -> int:
        """Offer every document that can enter ``best``; returns the number of cells looked at."""
        rows = rows[rows < 1 << self.height].astype(np.int64)
        looked = 0
        if not len(rows):
            return looked
        bound = np.array([self.value[0] * len(rows)])
        level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cell = np.zeros((1, len(rows)), np.int64)  # -1: the row has nothing in the range
        while len(bound):
            if len(bound) > TOGETHER:
                split = np.argpartition(bound, len(bound) - TOGETHER)
                now, later = split[-TOGETHER:], split[:-TOGETHER]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            own, depth = cell[now], level[now] + 1
            looked += own.size
            row_bit = (rows[None, :] >> (self.height - depth)[:, None]) & 1
            mask, first = self.mask[own], self.first[own]
            halves = []
            for side in (0, 1):
                quarter = 2 * row_bit + side
                there = (own >= 0) & ((mask >> quarter.astype(np.uint8)) & 1).astype(bool)
                halves.append(np.where(there, first + _BEFORE[mask, quarter], -1))
            below = np.concatenate(halves)
            tops = np.where(below >= 0, self.value[below], 0).sum(axis=1)
            depths = np.concatenate([depth, depth])
            columns = np.concatenate([2 * column[now], 2 * column[now] + 1])
            possible = (tops > 0) & (tops >= best.floor)
            leaf = possible & (depths == self.height)
            if leaf.any():
                best.offer(tops[leaf], self.ids[columns[leaf]])
            going = possible & (depths < self.height)
            keep_ = later[bound[later] >= best.floor]
            bound = np.concatenate([bound[keep_], tops[going]])
            level = np.concatenate([level[keep_], depths[going]])
            column = np.concatenate([column[keep_], columns[going]])
            cell = np.concatenate([cell[keep_], below[going]])
        return looked


class Best:
    """The k best (score, id) so far; nothing below ``floor`` can enter."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.floor = k, floor
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.score, scores]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.score, self.id = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def impact(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: ``doc_id``, ``n`` terms, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, sizes, numbers, times, ends = [], [], [], [], [0]
            for id_, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                found = terms(text.as_py())
                if not found:
                    continue
                ids.append(id_)
                sizes.append(len(found))
                for term, tf in Counter(found).items():
                    number = known.get(term)
                    if number is not None:
                        numbers.append(number)
                        times.append(tf)
                ends.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (numbers, times)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>")


def frequencies(counted: DataFrame, size: int) -> dict[int, int]:
    """Documents that hold each term of the vocabulary; a task adds up its own documents first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(pa.compute.list_flatten(batch["terms"]).to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    rows = counted.select("terms").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.collect()}


def build(counted: DataFrame, documents: int, words: int, weights: np.ndarray, row_of: np.ndarray) -> DataFrame:
    """The treaps of all shards; ``weights`` and ``row_of`` by the number of a term."""
    shared = counted.sparkSession.sparkContext.broadcast((weights, row_of))

    def shard(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        w, rows = shared.value
        table = pa.Table.from_batches(part).combine_chunks()
        lists = table["terms"].combine_chunks()
        term = pa.compute.list_flatten(lists).to_numpy()
        tf = pa.compute.list_flatten(table["tf"].combine_chunks()).to_numpy().astype(np.int64)
        column = np.repeat(np.arange(table.num_rows), pa.compute.list_value_length(lists).to_numpy())
        n = table["n"].to_numpy().astype(object if int(pa.compute.max(table["n"]).as_py()) * 50 * documents >= 1 << 62 else np.int64)
        m = (50 + (50 * n * documents) // words).astype(np.int64)
        found = impact(w[term], tf, m[column])
        some = np.flatnonzero(found > 0)
        saved = [Treap.build(rows[term[some]], column[some], found[some], table["doc_id"].to_numpy()).save()] if len(some) else []
        return pa.RecordBatch.from_pylist(saved, shape)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, postings = [], 0, 0
        for batch in batches:
            at = 0
            held = pa.compute.list_value_length(batch["terms"]).to_numpy().cumsum()
            while at < batch.num_rows:
                before = int(held[at - 1]) if at else 0
                full = int(np.searchsorted(held, before + SHARD_POSTINGS - postings)) + 1
                stop = min(batch.num_rows, full, at + SHARD_DOCS - docs)
                stop = max(stop, at + 1)
                part.append(batch.slice(at, stop - at))
                docs, postings, at = docs + stop - at, postings + int(held[stop - 1]) - before, stop
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield shard(part)
                    part, docs, postings = [], 0, 0
        if part:
            yield shard(part)

    shape = pa.schema(
        [("height", pa.int32()), ("cells", pa.int64()), ("top", pa.int64()), ("masks", pa.binary())]
        + [("width", pa.int32()), ("differences", pa.binary()), ("ids", pa.binary())]
    )
    schema = "height int, cells long, top long, masks binary, width int, differences binary, ids binary"
    return counted.mapInArrow(index, schema)


def search(treaps: DataFrame, rows_of_items: dict[int, np.ndarray], k: int, floors: dict[int, int]) -> DataFrame:
    """``item, doc_id, score``: per task the k best documents of every item, none below its floor."""
    shared = treaps.sparkSession.sparkContext.broadcast((rows_of_items, floors))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, least = shared.value
        best = {item: Best(k, least.get(item, 1)) for item in wanted}
        for batch in batches:
            for saved in batch.to_pylist():
                tree = Treap.load(saved)
                for item, rows in wanted.items():
                    tree.search(rows, best[item])
        for item, own in best.items():
            if len(own.id):
                columns = [pa.array(np.full(len(own.id), item)), pa.array(own.id), pa.array(own.score)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return treaps.drop("number").mapInArrow(look, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(items: DataFrame, docs: DataFrame, k: int = 50, id_: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest score above 0 for every row of ``items``."""
    spark = items.sparkSession

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms(t.as_py()))) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["item"], batch["item_id"], pa.array(own, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_).cast("long").alias("item_id"), F.col(text).alias("text"))
    asked = keep(numbered.mapInArrow(distinct, "item long, item_id long, terms array<binary>"), "items")
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(total / VOCABULARY))
    results = []
    for block in range(blocks):
        # a block of items: its terms are what a bounded vocabulary holds, the longest item aside
        wanted = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "terms").collect()
        vocabulary: dict[bytes, int] = {}
        for r in wanted:
            for term in r.terms:
                vocabulary.setdefault(bytes(term), len(vocabulary))
        if vocabulary:
            results.append(_rank_block({r.item: [vocabulary[bytes(t)] for t in r.terms] for r in wanted if r.terms}, vocabulary, docs, k))
    names = asked.select("item", "item_id")
    empty = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    found = empty
    for result in results:
        found = found.unionByName(result)
    return found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _rank_block(wanted: dict[int, list[int]], vocabulary: dict[bytes, int], docs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    counted = keep(count_terms(docs, vocabulary), "counted", compression="zstd")
    totals = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
    if not totals.documents:
        return spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    df = frequencies(counted, len(vocabulary))
    weights = np.array([weight(totals.documents, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    # frequent terms are neighbours, so that dense rows share cells
    row_of = np.empty(len(vocabulary), np.int64)
    row_of[sorted(range(len(vocabulary)), key=lambda t: (-df.get(t, 0), t))] = np.arange(len(vocabulary))
    rows_of_items = {item: np.sort(row_of[[t for t in own if df.get(t)]]) for item, own in wanted.items()}
    rows_of_items = {item: own.astype(np.int64) for item, own in rows_of_items.items() if len(own)}
    built = build(counted, totals.documents, totals.words, weights, row_of).withColumn("number", F.monotonically_increasing_id())
    treaps = keep(built, "treaps", compression="zstd")
    forget(counted)
    early = F.pmod(F.xxhash64("number"), F.lit(FIRST)) == 0
    first = keep(_ranked(search(treaps.where(early), rows_of_items, k, {}), k), "first-ranks")
    # one number per item of the block
    floors = {r.item: r.score for r in first.where(F.col("rank") == k).collect()}
    rest = search(treaps.where(~early), rows_of_items, k, floors)
    return keep(_ranked(first.drop("rank").unionByName(rest), k), "ranks")
