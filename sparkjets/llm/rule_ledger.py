"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and
one integer whose bit r says that rule r failed. Policies are versioned masks over
these bits: applying one, changing one or asking what a rule costs never reads a
text again. Ablations aggregate the bits: at most ``2 ** rules`` patterns, counted
per pattern and combined with bitwise operations.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words; they fail the
rules that demand some and pass those that bound a share. Every row is judged by itself:
rows that repeat an id or a text give an entry each, a null id stays null. An empty table
has an empty ledger and no ablation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = b" \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule -> what makes it fail, in measurements; the place in this table is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "10 * n_capitals > 3 * word_chars",
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


@dataclass(frozen=True)
class Policy:
    """A set of rules that reject; ``version`` names it in results."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(rule) for rule in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(RULES))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    if len(words) < 3:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], np.int64)
    n = len(number)
    if n == len(words):
        return 0
    pairs = ids[:-1] * n + ids[1:]
    if n > 1 << 20:  # three of them would not fit 64 bits
        _, pairs = np.unique(pairs, return_inverse=True)
    _, place, times = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = times[place] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : len(words) - 2 + shift] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORDS.findall(text)
    raw = text.encode("utf-8", "surrogatepass")
    between = len(raw) - len(raw.translate(None, BETWEEN))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return (
        len(words),
        len(text) - between,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(raw) - len(raw.translate(None, CAPITALS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measurements(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measure(text) for text in batch], columns=list(MEASURES), dtype="int64")


def failure_bits(measured: str) -> Column:
    """Bit r is set where rule r fails; ``measured`` names the struct of measurements."""
    bits = F.lit(0).cast("long")
    for rule, fails in RULES.items():
        text = re.sub(r"[a-z]\w*", lambda m: f"{measured}.{m[0]}", fails)
        bits = bits + F.when(F.expr(text), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, every measurement and ``fail_bits``: one row per row of ``docs``."""
    measured = docs.select("doc_id", measurements("text").alias("m"))
    return measured.select("doc_id", *(f"m.{name}" for name in MEASURES), failure_bits("m").alias("fail_bits"))


def fails(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    column = F.col(bits) if isinstance(bits, str) else bits
    return column.bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``policy`` (its version) and ``kept``."""
    return entries.withColumns({"policy": F.lit(policy.version), "kept": ~fails(policy)})


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents it fails, those that only it rejects, and those kept without it."""
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in policy.rules)))
    of_policy = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    each = patterns.select(of_policy.alias("bits"), "n", rules.alias("r")).select("bits", "n", "r.*")
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("b")) != 0).alias("n_fail"),
        count(F.col("bits") == F.col("b")).alias("n_only_this"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("b"))) == 0).alias("n_kept_without"),
    ).withColumn("policy", F.lit(policy.version))


def passing(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only."""
    name = "m"
    while name in docs.columns:
        name += "_"
    measured = docs.withColumn(name, measurements(F.col("text")))
    return measured.where(~fails(policy, failure_bits(name))).drop(name)
