"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted: one over target texts (a
bounded sample of labelled good documents), one over every document. The log of
their ratio, summed over a text, is its importance weight. Documents are drawn
without replacement in proportion to their weights by Gumbel top-k: each weight
gets Gumbel noise that only depends on the document, and the k largest are kept.
k is the number of documents whose weight passes a threshold that is calibrated
on labelled documents the target model has not seen.

The counts are bounded by the number of buckets, whatever the corpus; the k-th
largest key is found by three rounds of counting key bits, not by sorting.

Null and empty texts have weight 0. Rows of one id and text get one and the same key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.llm.common import once

TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Hash buckets of single tokens and of pairs.
SINGLES, PAIRS = 1 << 17, 1 << 16
#: Labelled rows that the models and the threshold are fitted on, at most, chosen by a hash of the id.
LABELLED = 40_000
#: Added to the counts of a bucket in both models.
PRIOR = 1.0
#: Standard errors by which the log ratio of a bucket is drawn towards 0: of single tokens, and of pairs.
CAUTION = (1.5, 6.0)
#: Scale of the Gumbel noise against the log weights; below 1, clear cases are hardly ever drawn the other way.
TEMPERATURE = 0.2
#: A rejected good document weighs as much as so many bad documents kept.
COST = 3.0
SEED = 20_24
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Token -> 64-bit hash, kept while there is room."""

    def __missing__(self, token: str) -> int:
        if len(self) > 60_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every token and every pair of neighbours of a text; pairs come after the ``SINGLES``."""
    if not text:
        return np.empty(0, np.int64)
    tokens = TOKENS.findall(text.lower())
    hashed = np.fromiter(map(once("token hashes", _Hashes).__getitem__, tokens), np.uint64, len(tokens))
    single = hashed >> np.uint64(64 - SINGLES.bit_length() + 1)
    pair = (hashed[:-1] * _MIX + hashed[1:]) * _MIX >> np.uint64(64 - PAIRS.bit_length() + 1)
    return np.concatenate([single, pair + np.uint64(SINGLES)]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log ratio per bucket and the weight from which a document counts as good."""

    log_ratio: np.ndarray
    threshold: float
    fitted_on: int

    def weight(self) -> Column:
        ratio = self.log_ratio

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield pd.Series([float(ratio[buckets(text)].sum()) for text in batch], dtype="float64")

        return score(F.col("text"))


def sampled_labels(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids with ``good`` and ``held`` (set aside for the threshold).

    Ids with null or contradicting labels are left out.
    """
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    per_id = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
    clear = per_id.agg(F.min(good).alias("good"), F.max(good).alias("most")).where("good = most")
    draw = F.xxhash64("doc_id", F.lit(SEED))
    chosen = clear.select("doc_id", "good", draw.alias("draw")).orderBy("draw", "doc_id").limit(limit)
    return chosen.select("doc_id", "good", (F.pmod("draw", F.lit(3)) == 0).cast("int").alias("held"))


def count_models(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over target documents and over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = SINGLES + PAIRS
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for text, chosen in zip(batch["text"], batch["target"].to_pylist()):
                found = np.bincount(buckets(text.as_py()), minlength=1)
                raw[: len(found)] += found
                if chosen:
                    target[: len(found)] += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    chosen = sample.where("good = 1 AND held = 0").select("doc_id", F.lit(True).alias("target"))
    # the sample has LABELLED rows at most
    flagged = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", "target")
    rows = flagged.mapInArrow(count, "bucket long, raw long, target long")
    totals = rows.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toPandas()
    raw, target = np.zeros(SINGLES + PAIRS), np.zeros(SINGLES + PAIRS)
    at = totals["bucket"].to_numpy(np.int64)
    raw[at], target[at] = totals.iloc[:, 1].to_numpy(float), totals.iloc[:, 2].to_numpy(float)
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two models; what chance alone can explain in a bucket is no evidence.

    A group of copies has words of its own, which a sample of the group's size may
    well miss: many small ratios that would add up against good documents.
    """
    out = np.zeros(len(raw))
    for part, caution in zip((slice(0, SINGLES), slice(SINGLES, None)), CAUTION):
        if target[part].sum():
            have = target[part] + PRIOR
            expected = raw[part] * (target[part].sum() / raw[part].sum()) + PRIOR
            ratio, error = np.log(have / expected), np.sqrt(1 / have + 1 / expected)
            out[part] = np.sign(ratio) * np.maximum(np.abs(ratio) - caution * error, 0)
    return out


def best_threshold(good: np.ndarray, bad: np.ndarray, cost: float = COST) -> float:
    """Threshold of least cost between weights of good and of bad documents; without bad ones below all good ones."""
    if not len(bad) or not len(good):
        return -np.inf
    edges = np.sort(np.concatenate([good, bad]))
    edges = np.append((edges[:-1] + edges[1:]) / 2, edges[0] - 1)
    lost = np.searchsorted(np.sort(good), edges, "left")
    passed = len(bad) - np.searchsorted(np.sort(bad), edges, "left")
    return float(edges[np.lexsort((edges, cost * lost + passed))[0]])


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """Count both models over ``docs`` and calibrate the threshold on labelled documents set aside."""
    sample = sampled_labels(labels, limit)
    chosen = sample.sparkSession.createDataFrame(sample.toPandas(), "doc_id long, good int, held int")
    target, raw = count_models(docs, chosen)
    model = Model(log_ratio(target, raw), -np.inf, int(target.sum()))
    held = docs.select("doc_id", "text").join(F.broadcast(chosen.where("held = 1")), "doc_id")
    scored = held.select("good", model.weight().alias("w")).toPandas()  # at most LABELLED rows
    is_good = scored["good"].to_numpy() == 1
    weights = scored["w"].to_numpy()
    return Model(model.log_ratio, best_threshold(weights[is_good], weights[~is_good]), model.fitted_on)


def gumbel(*key: str | Column) -> Column:
    """Standard Gumbel noise from a hash of the key: the same on every run and partitioning."""
    uniform = (F.pmod(F.xxhash64(*key, F.lit(SEED)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def sortable(value: Column) -> Column:
    """A long that is ordered as the doubles are: value in units of 2^-20, which no weight exceeds."""
    return F.floor(F.least(F.greatest(value, F.lit(-2.0**40)), F.lit(2.0**40)) * float(1 << 20)).cast("long")


def kth_largest(values: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest long of a column, and how many rows that equal it belong to the k largest.

    Each round counts one group of bits below the prefix found so far: at most
    2^16 counts come back, four times.
    """
    offset, shift, prefix = 1 << 62, 48, 0
    shifted = (F.col(column) + F.lit(offset)).alias("v")
    left = k
    while shift >= 0:
        rows = values.select(shifted)
        if shift < 48:
            rows = rows.where(F.shiftright("v", shift + 16) == F.lit(prefix))
        group = F.shiftright("v", shift).bitwiseAND(F.lit((1 << 16) - 1)).alias("g")
        counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()
        for g, n in sorted(((int(r.g), int(r.n)) for r in counts), reverse=True):
            if n >= left:
                prefix = (prefix << 16) | g
                break
            left -= n
        shift -= 16
    return prefix - offset, left


def resample(weighted: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """Keep the k largest of ``log_weight`` plus noise (``key``); k counts the weights that reach ``threshold``.

    ``weighted`` is a kept table with ``doc_id``, ``text_hash`` and ``log_weight``. Equal
    keys at the border are told apart by a hash of the row; rows equal in that too
    are kept together.
    """
    k = weighted.where(F.col("log_weight") >= F.lit(threshold)).count()
    keyed = weighted.withColumn("key", sortable(F.col("log_weight") + F.lit(TEMPERATURE) * gumbel("doc_id", "text_hash")))
    if k == 0:
        return keyed.withColumn("kept", F.lit(False)), 0
    border, inside = kth_largest(keyed, "key", k)
    ties = keyed.where(F.col("key") == F.lit(border)).withColumn("tie", F.xxhash64("doc_id", "text_hash"))
    last, _ = kth_largest(ties.withColumn("tie", F.shiftright("tie", 2)), "tie", inside)
    tie = F.shiftright(F.xxhash64("doc_id", "text_hash"), 2)
    kept = (F.col("key") > F.lit(border)) | ((F.col("key") == F.lit(border)) & (tie >= F.lit(last)))
    return keyed.withColumn("kept", kept), k
