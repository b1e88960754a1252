"""Packing of documents into as few fixed-length sequences as possible.

Only the histogram of piece lengths is needed to plan: at most ``capacity`` counts,
however many documents there are. The plan is a configuration linear program (how
often to use each way of filling a sequence), solved by multiplicative weights: a
knapsack dynamic program finds the configuration that is worth most at the current
prices of the lengths, and what it covers gets cheaper. Configurations that fill
their sequence are rounded down; the pieces that are left are priced once more, one
configuration after the other, until none is left. Pieces then take their places by
their rank among the pieces of their length, so no task ever holds more than its own
rows.

A document longer than ``capacity`` is cut into full pieces, of which the first may
be shorter. Null and empty texts are documents that hold the end id only. Every row is packed by itself:
rows that repeat an id or a text take their own places, a null id stays null.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkjets.llm.common import keep, offsets
from sparkjets.llm.tokens import encoder

CAPACITY = 2048
#: Rounds of multiplicative weights at most; each covers a length for good, or nearly.
ROUNDS = 4 * CAPACITY
#: Each round covers at most this share of the pieces of the scarcest length it uses.
STEP = 1.0
#: Lengths that one knapsack program looks at; where more are left, they take turns.
PRICED = 256
#: How fast the price of a length falls with its coverage.
RATE = 6.0
#: Power of a length in its price; above 1 long pieces go first, and the short ones that fit anywhere are left to the end.
LEAN = 1.05



def best_filling(price: np.ndarray, lengths: np.ndarray, limit: np.ndarray, capacity: int) -> Counter:
    """The configuration of greatest total price that fits ``capacity`` and uses no length more often than ``limit``.

    A bounded knapsack by dynamic programming: the pieces of a length stand in bundles of 1, 2, 4, ... pieces.
    """
    bundles = []
    for k in np.flatnonzero(price > 0).tolist():
        left, size = min(int(limit[k]), capacity // int(lengths[k])), 1
        while left > 0:
            bundles.append((k, min(size, left)))
            left -= size
            size *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(bundles), capacity + 1), bool)
    for i, (k, n) in enumerate(bundles):
        room = int(lengths[k]) * n
        worth = best[: capacity + 1 - room] + price[k] * n
        np.greater(worth, best[room:], out=taken[i, room:])
        best[room:] = np.maximum(best[room:], worth)
    found: Counter = Counter()
    room = capacity
    for i in range(len(bundles) - 1, -1, -1):
        if taken[i, room]:
            k, n = bundles[i]
            found[k] += n
            room -= int(lengths[k]) * n
    return found


def in_turn(of: np.ndarray, turn: int) -> np.ndarray:
    """Every m-th of ``of``, at most ``PRICED`` and from long to short alike; another m-th at every turn."""
    m = -(-len(of) // PRICED)
    return of[turn % m :: m] if m > 1 else of


def solve_configurations(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Fractional solution of the configuration program: (length -> pieces, how many sequences), by multiplicative weights."""
    lengths = np.array(sorted(counts), np.int64)
    have = np.array([counts[int(n)] for n in lengths], float)
    covered = np.zeros(len(lengths))
    worth = lengths.astype(float) ** LEAN
    used: dict[tuple, float] = {}
    for turn in range(rounds):
        if covered.min(initial=1.0) >= 1.0:
            break
        # covered lengths are worth nothing, others what they fill, dearer the less they are covered
        price = np.zeros(len(lengths))
        at = in_turn(np.flatnonzero(covered < 1.0), turn)
        price[at] = worth[at] * np.exp(RATE * (covered.mean() - covered[at]))
        filling = best_filling(price, lengths, have, capacity)
        amount = min(have[k] * STEP / n for k, n in filling.items())
        amount = max(amount, 1.0)
        key = tuple(sorted(filling.items()))
        used[key] = used.get(key, 0.0) + amount
        for k, n in filling.items():
            covered[k] += amount * n / have[k]
    return [({int(lengths[k]): n for k, n in key}, amount) for key, amount in used.items()]


def round_up(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for what rounding down leaves: the dearest configuration of the pieces left, as often as they allow.

    Each one nearly uses up a length, so the work grows with the number of lengths.
    """
    plan, rest = [], {length: n for length, n in counts.items() if n}
    while rest:
        lengths = in_turn(np.array(sorted(rest), np.int64), len(plan))
        have = np.array([rest[int(n)] for n in lengths], np.int64)
        content = {int(lengths[k]): c for k, c in best_filling(lengths.astype(float) ** LEAN, lengths, have, capacity).items()}
        n = min(rest[length] // c for length, c in content.items())
        plan.append((content, n))
        for length, c in content.items():
            rest[length] -= n * c
        rest = {length: n for length, n in rest.items() if n}
    return plan


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """How to fill all sequences: (length -> pieces, number of such sequences); every piece has exactly one place."""
    rest = dict(counts)
    full = rest.pop(capacity, 0)
    plan = [({capacity: 1}, full)] if full else []
    for content, amount in sorted(solve_configurations(rest, capacity, rounds), key=lambda x: -x[1]) if rest else []:
        n = min([math.floor(amount + 1e-9), *(rest[length] // k for length, k in content.items())])
        if n > 0 and sum(length * k for length, k in content.items()) == capacity:
            plan.append((content, n))
            for length, k in content.items():
                rest[length] -= n * k
    return plan + round_up(rest, capacity)


class Places:
    """The plan as arrays: where the pieces of each length lie, by their rank."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        taken: Counter = Counter()
        rows = []
        sequence = 0
        for content, n in plan:
            at = 0
            for length, k in sorted(content.items(), reverse=True):
                for _ in range(k):
                    rows.append((length, taken[length], sequence, at))
                    taken[length] += n
                    at += length
            sequence += n
        rows.sort()
        self.n_sequences = sequence
        self.key = np.array([(length << 44) + first for length, first, _, _ in rows], np.int64)
        self.first, self.sequence, self.at = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, "right") - 1
        return self.sequence[k] + rank - self.first[k], self.at[k]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Encode whole texts and cut them: one kept row per piece with its ids and its rank within its task and length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        part, seen, end = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4")
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "rank_in_part", "ids")}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.append(encode.encode(text.as_py()), end)
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for i, start in enumerate(starts):
                    got = ids[start : starts[i + 1] if i + 1 < len(starts) else None]
                    values = (doc, i, start, len(got), seen[len(got)], got.tobytes())
                    seen[len(got)] += 1
                    for column, value in zip(columns.values(), values):
                        column.append(value)
            n = len(columns["piece"])
            arrays = [pa.array([part] * n, pa.int32())]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays += [pa.array(column, kind) for column, kind in zip(columns.values(), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", *columns])

    schema = "part int, doc_id long, piece int, start long, length long, rank_in_part long, ids binary"
    return keep(docs.select("doc_id", "text").mapInArrow(pieces, schema), "pieces", "zstd")


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    The rank of a piece among all pieces of its length is its rank within its task
    plus the pieces of that length in earlier tasks: a running total over one row
    per task and length, never over pieces.
    """
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = offsets(per_part, ["part"], "n", "before", ["length"])
    # at most ``capacity`` rows
    counts = {int(r[0]): int(r[1]) for r in per_part.groupBy("length").agg(F.sum("n")).collect()}
    places = Places(plan_sequences(counts, capacity, rounds))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch["rank_in_part"].to_numpy() + batch["before"].to_numpy()
            sequence, at = places.find(batch["length"].to_numpy(), rank)
            kept = [n for n in batch.schema.names if n not in ("part", "rank_in_part", "before")]
            arrays = [*(batch[n] for n in kept), pa.array(sequence), pa.array(at)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "sequence_id", "offset"])

    ranked = pieces.join(before.drop("n"), ["part", "length"])
    kept = ", ".join(f"{n} {t}" for n, t in ranked.dtypes if n not in ("part", "rank_in_part", "before"))
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids stay in the kept table of pieces; ``materialise`` brings them together.
    """
    pieces = cut_pieces(docs, capacity, end_id, vocabulary)
    narrow = pieces.select(
        "part", "doc_id", "piece", "start", "length", "rank_in_part", F.crc32("ids").alias("ids_crc32")
    )
    return assign_sequences(narrow, capacity)


def materialise(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and its ids in order, from pieces that carry ``ids``, ``sequence_id`` and ``offset``.

    At most ``capacity`` pieces meet in a group.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
