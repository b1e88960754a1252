"""Chunked, resumable ingest of files as a bounded stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType | None = None,
    max_files_per_chunk: int = 1,
    to_int: Sequence[str] = (),
    to_float: Sequence[str] = (),
    entry_id: str | None = None,
    entry_start: int | None = None,
    entry_stop: int | None = None,
    file_format: str = "parquet",
    pattern: str | None = None,
) -> DataFrame:
    """Read every new file once, in chunks, cast, and append to ``target``; returns the whole target.

    The checkpoint remembers finished files, so a second run, or one after a
    crash, continues where the first stopped and never writes a file twice.
    """
    if schema is None:
        schema = spark.read.format(file_format).load(source).schema
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", max_files_per_chunk)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(source)
    if entry_id is not None and entry_start is not None:
        rows = rows.where(F.col(entry_id) >= entry_start)
    if entry_id is not None and entry_stop is not None:
        rows = rows.where(F.col(entry_id) < entry_stop)
    casts = {c: "int" for c in to_int} | {c: "float" for c in to_float}
    rows = rows.withColumns({name: F.col(name).cast(kind) for name, kind in casts.items()})
    query = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)
