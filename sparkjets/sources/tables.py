"""Jet views over the star-schema test tables (orders as jets, line items as constituents)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkjets.functions.labels import quark_gluon
from sparkjets.operators.nested import nest


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jets(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order. A projection of the scan: unused columns are never read."""
    key = F.col("o_orderkey")
    digit = key % 10
    parton = F.when(digit <= 5, digit + 1).when(digit <= 8, 21).otherwise(-1).cast("int")
    label = quark_gluon(parton, F.lit(None))
    weight = (1 + key % 5).cast("double")
    base = table(spark, folder, "orders").select(
        key.alias("jet_id"),
        F.col("o_custkey").alias("event_id"),
        F.col("o_totalprice").alias("jets_pt"),
        (((key * 31) % 901).cast("double") / 100.0 - 4.5).alias("jets_eta"),
        (((key * 17) % 629).cast("double") / 100.0 - 3.14).alias("jets_phi"),
        (F.col("o_totalprice") * 0.1).alias("jets_m"),
        parton.alias("parton"),
        label.cast("int").alias("label"),
        weight.alias("weight"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("slice"),
        F.col("o_orderstatus").alias("generator"),
    )
    return base.withColumn("score", model_score(7919)).withColumn(
        "weight_mc", F.array(F.col("weight"), F.col("weight") * 1.1, F.col("weight") * 0.9)
    )


def model_score(multiplier: int, separation: float = 0.2):
    """A reproducible score in [0, 1]: a scrambled key, shifted up for label 1."""
    noise = ((F.col("jet_id") * multiplier) % 10007).cast("double")
    bonus = F.when(F.col("label") == 1, F.lit(separation)).otherwise(F.lit(0.0))
    return F.lit(1.0 - separation) * noise / 10007.0 + bonus


def constituents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("jet_id"),
        F.col("l_extendedprice").alias("pt"),
        (F.col("l_discount") * 50.0 - 2.5).alias("eta"),
        (F.col("l_quantity") / 50.0 * 2.0 * math.pi - math.pi).alias("phi"),
        (F.col("l_tax") * 1000.0).alias("m"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
    )


CONSTITUENT_ORDER = ("pt desc", "l_linenumber", "l_partkey", "l_suppkey", "phi", "eta", "m")


def _constituent_order():
    return [F.col("pt").desc(), *[F.col(c) for c in CONSTITUENT_ORDER[1:]]]


def nested_constituents(spark: SparkSession, folder: str, kind: str = "Constituent", source=None) -> DataFrame:
    """Per jet all its constituents as aligned arrays ``jets_<kind>_{pt,eta,phi,m}``, pt descending."""
    rows = constituents(spark, folder) if source is None else source
    columns = {f"jets_{kind}_{k}": k for k in ("pt", "eta", "phi", "m")}
    return nest(rows, ["jet_id"], _constituent_order(), columns)


def jets_nested(spark: SparkSession, folder: str) -> DataFrame:
    """All jets with the arrays of their constituents; a jet without any has empty arrays."""
    arrays = nested_constituents(spark, folder)
    joined = jets(spark, folder).join(arrays, "jet_id", "left")
    empty = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in arrays.schema if f.name != "jet_id"}
    return joined.withColumns(empty)


def events_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Per event all its jets as aligned arrays, with event scalars and an array that is not per jet."""
    columns = {
        "jets_id": "jet_id",
        "jets_pt": "jets_pt",
        "jets_eta": "jets_eta",
        "jets_phi": "jets_phi",
        "jets_m": "jets_m",
        "jets_parton": "parton",
    }
    order = [F.col("jets_pt").desc(), F.col("jet_id")]
    records = nest(jets(spark, folder), ["event_id"], order, columns)
    events = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("event_id"),
        F.col("c_acctbal").alias("mu"),
        F.col("c_nationkey").alias("nation"),
        F.array(F.col("c_custkey") % 3, F.col("c_custkey") % 5).alias("vertex_id"),
        (F.col("c_custkey") % 2).cast("int").alias("HLT_pass"),
    )
    return records.join(events, "event_id")


def jets_with_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Jets with the region of their customer as the sample name."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("sample"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    places = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, F.col("n_regionkey") == region.r_regionkey
    )
    found = places.select(F.col("c_custkey").alias("event_id"), "sample")
    return jets(spark, folder).join(found, "event_id")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sample descriptions, one per region."""
    return table(spark, folder, "region").select(
        F.col("r_name").alias("sample"),
        (F.lit(100.0) * (F.col("r_regionkey") + 1)).alias("cross_section"),
        (F.lit(1.0) / (F.col("r_regionkey") + 2)).alias("filt_eff"),
        F.lit("sum_w").alias("norm_name"),
    )


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Long metadata per sample: sum of weights and number of jets."""
    sums = jets_with_sample(spark, folder).groupBy("sample").agg(
        F.sum("weight").alias("sum_w"), F.count(F.lit(1)).cast("double").alias("num_events")
    )
    return sums.unpivot("sample", ["sum_w", "num_events"], "key", "value")
