"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage works on all rows that the one before it kept, and hands on the columns
of ``documents`` (the last: the places of all pieces). Between stages the rows are
written to the shared folder and read again, so a lost executor costs no earlier
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkjets.llm import importance, near_dups, packing, rule_ledger
from sparkjets.llm.common import bound_batches, forget, keep, table, text_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the standard policy of the rule ledger rejects; empty and null texts go with it."""
    bound_batches(spark)
    return rule_ledger.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the documents labelled good; what is not drawn goes."""
    model = importance.fit(docs, table(spark, sf_dir, "labels"))
    own = docs.columns
    named = docs.select(F.struct(*own).alias("row"), F.col("doc_id"), text_key().alias("text_hash"), F.col("text"))
    weighted = keep(named.select("row", "doc_id", "text_hash", model.weight().alias("log_weight")), "weighted")
    drawn, _ = importance.resample(weighted, model.threshold)
    return drawn.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays."""
    bound_batches(spark)
    return near_dups.first_of_each(docs, words=5, threshold=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents that are left into sequences of 2048 tokens."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("best-fit packing", pack),
]

#: The classifier is a trained model, which SQL cannot state; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)  # its successor is written, nothing reads it again
    return docs
