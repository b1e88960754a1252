"""Resharding that moves as few bytes as possible.

From the sizes of the old shards and the capacities of the new ones, a minimum-cost
flow says how many bytes go from which shard to which. Which rows these are follows
from thresholds: rows of an old shard are ordered by a key, and each destination
takes one range of it, so the new shard of a row is an expression of the row alone
and needs no join. The thresholds are found by counting bytes per group of key bits,
a few at a time; only those counts reach the driver, bounded by the number of
shards. After the bulk, small rows are moved once or twice more in the same way
until sizes are near equal. Only shards that a transfer touches are written anew.

The size of a row is the UTF-8 bytes of its text (null: none) plus ``OVERHEAD``. Rows
that agree in id and text are indistinguishable and stay together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkjets.llm.common import keep, new_path, or_empty, text_key

OVERHEAD = 16
#: Key bits per round of counting.
BITS = 12
KEY_BITS = 60
#: Rounds that move small rows after the bulk.
POLISH = 3
#: Fewest tasks that write a shard, and the bytes of texts one of them takes.
WRITERS, WRITE_BYTES = 8, 256 << 20
#: Buckets per shard in which places are numbered.
SLOT_BUCKETS = 256


def min_cost_flow(supply: list[int], demand: list[int], cost: np.ndarray) -> dict[tuple[int, int], int]:
    """Flow from sources to sinks of least total cost (successive shortest paths with potentials).

    ``cost[i, j]`` per unit, not negative; ``sum(supply) == sum(demand)``. Graphs of
    shards are small: some hundreds of nodes.
    """
    n, m = len(supply), len(demand)
    left, wanted = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    potential = np.zeros(n + m)
    while True:
        start = [i for i in range(n) if left[i] > 0]
        if not start:
            return flow
        # Dijkstra from all open sources at once
        distance = np.full(n + m, np.inf)
        distance[start] = 0
        before = np.full(n + m, -1)
        done = np.zeros(n + m, bool)
        target = -1
        while True:
            open_ = np.where(done, np.inf, distance)
            u = int(open_.argmin())
            if not np.isfinite(open_[u]):
                raise ValueError("supply and demand differ")
            done[u] = True
            if u >= n and wanted[u - n] > 0:
                target = u
                break
            if u < n:
                through = distance[u] + np.maximum(cost[u] + potential[u] - potential[n:], 0)
                better = np.flatnonzero(~done[n:] & (through < distance[n:])) + n
                distance[better], before[better] = through[better - n], u
            else:
                for (i, j), amount in flow.items():
                    if j == u - n and amount and not done[i]:
                        through = distance[u] + max(potential[u] - potential[i] - cost[i, j], 0)
                        if through < distance[i]:
                            distance[i], before[i] = through, u
        potential += np.minimum(distance, distance[target])
        path, u = [], target
        while before[u] >= 0:
            path.append((int(before[u]), u))
            u = int(before[u])
        amount = min(left[u], wanted[target - n], *(flow[b, a - n] for a, b in path if a >= n))
        left[u] -= amount
        wanted[target - n] -= amount
        for a, b in path:
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + amount
            else:
                flow[b, a - n] -= amount


def transfers(sizes: dict[int, int], capacities: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes (old shard, new shard) -> amount; staying costs nothing, so as few bytes as possible move."""
    old, new = sorted(sizes), sorted(capacities)
    cost = np.array([[float(a != b) for b in new] for a in old]).reshape(len(old), len(new))
    flow = min_cost_flow([sizes[a] for a in old], [capacities[b] for b in new], cost)
    return {(old[i], new[j]): amount for (i, j), amount in flow.items() if amount}


def near_equal(total: int, shards: int) -> dict[int, int]:
    return {j: total * (j + 1) // shards - total * j // shards for j in range(shards)}


def row_size(text: str = "text") -> Column:
    return (F.octet_length(or_empty(text)) + F.lit(OVERHEAD)).cast("long")


def random_key(*columns: str | Column) -> Column:
    """An order without meaning: bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def small_first_key(size: Column, *columns: str | Column) -> Column:
    """Smallest rows first, equal sizes by a hash."""
    low = KEY_BITS // 2
    capped = F.least(size, F.lit((1 << (KEY_BITS - low)) - 1))
    return F.shiftleft(capped, low) + F.shiftrightunsigned(F.xxhash64(*columns), 64 - low)


@dataclass
class Cuts:
    """Where rows of a shard go: below each key threshold, in order, to one destination; the last takes the rest."""

    of: dict[int, list[tuple[int | None, int]]] = field(default_factory=dict)

    def destination(self, shard: Column, key: Column) -> Column:
        """One lookup in a literal table of ranges, whatever their number."""
        if not self.of:
            return shard
        ranges = []
        for home, cut in self.of.items():
            ends = [F.lit((1 << 63) - 1 if limit is None else limit).cast("long") for limit, _ in cut]
            steps = F.array(*(F.struct(e.alias("limit"), F.lit(to).alias("to")) for e, (_, to) in zip(ends, cut)))
            ranges += [F.lit(home), steps]
        own = F.try_element_at(F.create_map(*ranges), shard)
        first = F.try_element_at(F.filter(own, lambda step: key < step["limit"]), F.lit(1))
        return F.coalesce(first["to"], shard)


def key_thresholds(rows: DataFrame, wanted: dict[int, list[int]]) -> dict[int, list[int]]:
    """Per shard the keys below which its rows sum up to about the wanted running totals of bytes.

    ``rows``: shard, key, size. Refines all thresholds ``BITS`` bits at a time; a
    round returns at most ``2 ** BITS`` sums per threshold.
    """
    state = {(s, k): [0, 0, amount] for s, amounts in wanted.items() for k, amount in enumerate(amounts)}
    for shift in range(KEY_BITS - BITS, -1, -BITS):
        prefixes = sorted({(s, prefix) for (s, _), (prefix, _, _) in state.items()})
        if not prefixes:
            break
        condition = None
        for shard in sorted({s for s, _ in prefixes}):
            mine = [p for s, p in prefixes if s == shard]
            here = (F.col("shard") == shard) & F.shiftrightunsigned("key", shift + BITS).isin(mine)
            condition = here if condition is None else condition | here
        group = F.shiftrightunsigned("key", shift).alias("g")
        sums = rows.where(condition).groupBy("shard", group).agg(F.sum("size").alias("bytes")).collect()
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in sums:
            by.setdefault((r.shard, r.g >> BITS), []).append((r.g, int(r.bytes)))
        for (s, _), cell in state.items():
            prefix, below, amount = cell
            at = prefix << BITS
            for g, n in sorted(by.get((s, prefix), [])):
                if below + n > amount:
                    at = g
                    break
                below += n
                at = g + 1
            cell[:] = [at if at >> BITS == prefix else (prefix << BITS) + (1 << BITS) - 1, below, amount]
    return {s: [state[s, k][0] for k in range(len(amounts))] for s, amounts in wanted.items()}


def plan_cuts(rows: DataFrame, sizes: dict[int, int], capacities: dict[int, int]) -> tuple[Cuts, dict[tuple[int, int], int]]:
    """Solve the flow and find the thresholds; what leaves a shard comes first in its order, the rest stays."""
    flow = transfers(sizes, capacities)
    leaving: dict[int, list[tuple[int, int]]] = {}
    for (a, b), amount in sorted(flow.items()):
        if a != b:
            leaving.setdefault(a, []).append((b, amount))
    totals = {a: np.cumsum([n for _, n in out]).tolist() for a, out in leaving.items()}
    limits = key_thresholds(rows, totals)
    cuts = Cuts()
    for a, out in leaving.items():
        ranges = [(limit, b) for limit, (b, _) in zip(limits[a], out)]
        if (a, a) in flow or not out:
            ranges.append((None, a))
        elif a in capacities:
            ranges.append((None, a))
        else:
            ranges[-1] = (None, ranges[-1][1])
        cuts.of[a] = ranges
    return cuts, flow


@dataclass
class Plan:
    """Rounds of cuts; the first uses the random key, the others the key that begins with small rows."""

    rounds: list[Cuts]
    moved: dict[tuple[int, int], int]
    sizes: dict[int, int]

    def shard(self, old: Column, id_: str = "doc_id", text: str = "text") -> Column:
        size = row_size(text)
        shard = old
        for i, cuts in enumerate(self.rounds):
            key = small_first_key(size, id_, text_key(text)) if i else random_key(id_, text_key(text))
            shard = cuts.destination(shard, key)
        return shard


def shard_sizes(rows: DataFrame) -> dict[int, int]:
    return {int(r.shard): int(r.bytes) for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}


def plan(docs: DataFrame, old: Column, shards: int) -> Plan:
    """How to bring ``docs``, now in the shards that ``old`` names, into ``shards`` of near equal bytes."""
    narrow = keep(
        docs.select(
            old.cast("int").alias("shard"),
            row_size().alias("size"),
            random_key("doc_id", text_key()).alias("key"),
            small_first_key(row_size(), "doc_id", text_key()).alias("small"),
        ),
        "placement",
    )
    sizes = shard_sizes(narrow)
    capacities = near_equal(sum(sizes.values()), shards)
    if not sizes:
        return Plan([], {}, {})
    cuts, moved = plan_cuts(narrow.select("shard", "key", "size"), sizes, capacities)
    rounds = [cuts]
    rows = narrow.withColumn("shard", cuts.destination(F.col("shard"), F.col("key"))).drop("key").withColumnRenamed("small", "key")
    now = shard_sizes(rows)
    for _ in range(POLISH):
        if max(abs(now.get(j, 0) - c) for j, c in capacities.items()) <= OVERHEAD * 4:
            break
        cuts, _ = plan_cuts(rows, now, capacities)
        better = rows.withColumn("shard", cuts.destination(F.col("shard"), F.col("key")))
        then = shard_sizes(better)
        spread = lambda x: max(x.get(j, 0) for j in capacities) - min(x.get(j, 0) for j in capacities)
        if spread(then) >= spread(now):
            break
        rounds.append(cuts)
        rows, now = better, then
    return Plan(rounds, moved, now)


def reshard(docs: DataFrame, old: Column, shards: int, path: str | None = None) -> tuple[DataFrame, Plan]:
    """Rewrite the shards that change; returns all rows with ``shard`` in their new layout, and the plan.

    Shards that no transfer touches keep their rows where they are. The others are written by
    tasks of about ``WRITE_BYTES``, rows of one id with different texts by different ones. A column
    named ``shard`` is read by ``old`` if that says so, and replaced in the result.
    """
    made = plan(docs, old, shards)
    path = path or new_path(docs.sparkSession, "shards")
    columns = [F.col(c) for c in docs.columns if c != "shard"]
    placed = docs.select(*columns, made.shard(old.cast("int")).cast("int").alias("shard"))
    changed = sorted({s for cuts in made.rounds for s in cuts.of} | {to for cuts in made.rounds for r in cuts.of.values() for _, to in r})
    if not changed:
        return placed, made
    untouched = placed.where(~F.col("shard").isin(changed))
    rows = placed.where(F.col("shard").isin(changed))
    tasks = max(WRITERS, -(-max(made.sizes.values()) // WRITE_BYTES))
    spread = F.pmod(F.xxhash64(F.col("doc_id"), text_key()), F.lit(tasks))
    rows.repartition("shard", spread).write.partitionBy("shard").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    written = docs.sparkSession.read.schema(schema).parquet(path)
    kept = sorted(set(range(shards)) - set(changed))
    return (written.unionByName(untouched) if kept else written), made


def with_slots(rows: DataFrame) -> DataFrame:
    """``slot``: gapless places from 0 within each ``shard``, numbered in buckets of a hash of the id.

    A running total over one row per bucket gives each bucket its first place.
    """
    order = F.xxhash64("doc_id")
    bucketed = rows.withColumn("_bucket", F.pmod(order, F.lit(SLOT_BUCKETS)).cast("int"))
    totals = bucketed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(order, "doc_id")
    numbered = bucketed.withColumn("_n", F.row_number().over(inside)).join(first, ["shard", "_bucket"])
    return numbered.withColumn("slot", (F.col("_first") + F.col("_n") - 1).cast("long")).drop("_bucket", "_first", "_n")
