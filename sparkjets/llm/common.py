"""Tables kept in the cluster's shared folder, and small helpers of the operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def once(key: Hashable, make: Callable[[], Any]) -> Any:
    """Made once per Python worker and kept between its tasks.

    Functions travel with the job by value, so what their modules hold lives for one
    task only; this store belongs to the worker's process and is never sent.
    """
    store = sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


#: Session setting for the bytes of a batch that goes to a Python worker, its default, and ours.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Whole texts go to workers in batches of ``BATCH_BYTES``, unless the session has a setting of its own.

    A worker holds a batch several times over (as Arrow, as strings, as results).
    """
    now = (spark.conf.get(BATCH_SETTING, None) or "").lower().rstrip("b")
    if now in ("", str(BATCH_DEFAULT), "64m"):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where none is, the warehouse, which all executors reach too."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Written to the shared folder and read back: later steps start from files, not from lost executors' memory."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of kept tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str = "text") -> Column:
    """Tells rows of one id apart that hold different texts."""
    return F.xxhash64(F.col(text))


def offsets(totals: DataFrame, order: list[str], amount: str, out: str, within: list[str] | None = None) -> DataFrame:
    """Exclusive running total over a small table of totals (one row per partition or bucket, never per record)."""
    from pyspark.sql import Window

    window = Window.partitionBy(*(within or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(amount).over(window), F.lit(0)).cast("long"))
