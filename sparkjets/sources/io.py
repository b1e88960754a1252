"""Readers and writers for nested and flat tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.functions.binning import Binning
from sparkjets.functions.random import uniform
from sparkjets.operators.combine import concatenate, sample_mix, same_schema
from sparkjets.operators.ordered import keep_first, running_totals
from sparkjets.operators.split import shuffle

METADATA_SUFFIX = ".metadata"  # the metadata table lies beside the data folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach: in ``spark.checkpoint.dir``, or else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# ------------------------------------------------------------------- reading


def load(spark: SparkSession, path: str, shuffle_reading: bool = False, key: str | None = None, seed: int = 42) -> DataFrame:
    """A saved dataset. With ``shuffle_reading`` its rows come in a drawn order of ``key`` (of the whole row without one)."""
    df = spark.read.parquet(path)
    if not shuffle_reading:
        return df
    if key is not None:
        return shuffle(df, key, seed)
    return shuffle(df.withColumn("_row", F.xxhash64(*df.columns)), "_row", seed).drop("_row")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path.rstrip("/") + METADATA_SUFFIX)


def load_multiple(
    spark: SparkSession,
    paths: Sequence[str],
    labels: Sequence | None = None,
    dataset_mapper: Callable[[DataFrame, object], DataFrame] | None = None,
    data_mapper: Callable[[DataFrame, object], DataFrame] | None = None,
    mode: str = "concatenate",
    only_common: bool = False,
    key: str | None = None,
    weights: Sequence[float] | None = None,
    stop_on_empty: bool = True,
) -> DataFrame:
    """Load paths, map each with its label, combine them (``concatenate``, ``interleave`` or ``sample``)."""
    frames = []
    for i, path in enumerate(paths):
        df = spark.read.parquet(path)
        label = labels[i] if labels is not None else None
        if dataset_mapper is not None:
            df = dataset_mapper(df, label)
        if data_mapper is not None:
            df = data_mapper(df, label)
        if labels is not None and isinstance(label, (int, float, str)):
            df = df.withColumn("file_label", F.lit(label))
        frames.append(df)
    if mode == "sample":
        if key is None and weights is not None:
            raise ValueError("a weighted sample needs a key column")
        return sample_mix(frames, key or "", weights, stop_on_empty, only_common=only_common)
    if mode not in ("concatenate", "interleave"):
        raise ValueError(f"unknown mode {mode!r}")
    return concatenate(frames, only_common)


def load_parallel(
    spark: SparkSession,
    paths: Sequence[str],
    take: int | None = None,
    order: str | None = None,
    labels: Sequence[str] | None = None,
    dataset_mapper: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Load paths of one schema together, with the path of each row and at most ``take`` rows per path.

    The limit takes the first rows by ``order`` (numeric); only rows near the limit are shuffled.
    """
    frames = [spark.read.parquet(p) for p in paths]
    if not same_schema(frames):
        raise ValueError("files have different schemas")
    labels = list(paths) if labels is None else labels
    frames = [f.withColumn("file_label", F.lit(label)) for f, label in zip(frames, labels)]
    df = concatenate(frames if dataset_mapper is None else [dataset_mapper(f) for f in frames])
    if take is None:
        return df
    if order is None:
        raise ValueError("taking rows needs an order column")
    return keep_first(df, order, F.lit(take), ["file_label"])


def normalise_schema(
    df: DataFrame,
    downcast: bool = False,
    to_int: Sequence[str] = (),
    to_float: Sequence[str] = (),
    drop_empty: bool = True,
) -> DataFrame:
    """Schema of an ingested event table: drop arrays that are empty everywhere, cast as asked.

    Emptiness is one aggregate over array sizes, so only array columns are read for it.
    """

    def narrowed(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(narrowed(kind.elementType))
        if isinstance(kind, T.DoubleType):
            return T.FloatType()
        return T.IntegerType() if isinstance(kind, T.LongType) else kind

    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if drop_empty and arrays:
        largest = df.agg(*[F.max(F.size(F.col(f"`{a}`"))).alias(a) for a in arrays]).first()
        df = df.drop(*[a for a in arrays if not largest[a] or largest[a] <= 0])
    columns = []
    for f in df.schema.fields:
        kind = narrowed(f.dataType) if downcast else f.dataType
        kind = T.IntegerType() if f.name in to_int else T.FloatType() if f.name in to_float else kind
        columns.append(F.col(f"`{f.name}`").cast(kind).alias(f.name))
    return df.select(*columns)


def valid_slots(df: DataFrame, slots: str, flag: str = "valid") -> DataFrame:
    """Keep the array entries of a masked-slot column whose flag is set."""
    return df.withColumn(slots, F.filter(slots, lambda x: x[flag]))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_tagged_csv(
    spark: SparkSession, pattern: str, tags: str, names: Sequence[str], schema: str | T.StructType | None = None
) -> DataFrame:
    """Many CSV files in one read; each row gets tags cut from its path by the groups of a regular expression."""
    df = read_csv(spark, pattern, schema)
    path = F.input_file_name()
    return df.withColumns({name: F.regexp_extract(path, tags, i + 1) for i, name in enumerate(names)})


#: An empty Parquet file is no larger; a larger one without a row has lost its footer.
EMPTY_FILE_BYTES = 1 << 20
PARQUET_MARK = b"PAR1"


def file_facts(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """``path, bytes, rows, state`` of every Parquet file: "readable", "empty" or "unreadable" (its rows are NULL).

    Rows are counted by the footers: the scan asks for no column. Files that the scan
    passes over are looked at again, the few small ones among them by their marks. Spark
    lists no file of zero bytes.
    """

    def named(reader):
        return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)

    listing = named(spark.read.format("binaryFile")).load(folder).select("path", F.col("length").alias("bytes"))
    scan = named(spark.read.schema("`_none` int").option("ignoreCorruptFiles", True)).parquet(folder)
    counted = scan.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    found = listing.join(counted, "path", "left")
    silent = found.where("rows IS NULL").select("path").where(F.col("bytes") <= EMPTY_FILE_BYTES)
    small = named(spark.read.format("binaryFile")).load(folder).where(F.col("length") <= EMPTY_FILE_BYTES)
    ends = (F.col("content").substr(1, 4) == F.lit(PARQUET_MARK)) & (F.col("content").substr(-4, 4) == F.lit(PARQUET_MARK))
    whole = small.select("path", "content").join(silent, "path", "left_semi").where(ends & (F.length("content") > 12))
    judged = found.join(whole.select("path", F.lit(True).alias("_empty")), "path", "left")
    state = F.when(F.col("rows").isNotNull(), "readable").when(F.col("_empty"), "empty").otherwise("unreadable")
    rows = F.when(F.col("_empty"), F.lit(0).cast("long")).otherwise(F.col("rows"))
    return judged.select("path", "bytes", rows.alias("rows"), state.alias("state"))


def choose_files(
    facts: DataFrame, max_file_bytes: int | None = None, max_total_bytes: int | None = None, max_total_rows: int | None = None
) -> DataFrame:
    """``facts`` with ``choice``: "read", or why not ("unreadable", "too large", "over budget").

    Files are taken in the order of their paths until a total would pass a budget; what is
    unreadable or too large takes nothing from it. Totals run over ordered buckets of files.
    """
    large = F.lit(False) if max_file_bytes is None else F.col("bytes") > max_file_bytes
    first = F.when(F.col("state") == "unreadable", "unreadable").when(large, "too large")
    ordered = facts.withColumn("choice", first).orderBy("path").withColumn("_at", F.monotonically_increasing_id())
    path = shared_folder(facts.sparkSession)
    ordered = materialise(ordered, path)  # so that the numbers stay
    if max_total_bytes is None and max_total_rows is None:
        return ordered.withColumn("choice", F.coalesce("choice", F.lit("read"))).drop("_at")
    counts = {name: F.when(F.col("choice").isNull(), F.col(column)).otherwise(F.lit(0)) for name, column in (("_b", "bytes"), ("_r", "rows"))}
    totals = running_totals(ordered, "_at", counts)
    over = F.lit(False)
    for limit, total in ((max_total_bytes, "_b"), (max_total_rows, "_r")):
        if limit is not None:
            over = over | (F.col(total) > limit)
    return totals.withColumn("choice", F.coalesce("choice", F.when(over, "over budget").otherwise("read"))).drop("_at", "_b", "_r")


def select_files(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.parquet",
    max_file_bytes: int | None = None,
    max_total_bytes: int | None = None,
    max_total_rows: int | None = None,
) -> list[str]:
    """Paths to read within the limits, in order; see :func:`choose_files`. A reader takes a list, so this is one."""
    chosen = choose_files(file_facts(spark, folder, pattern), max_file_bytes, max_total_bytes, max_total_rows)
    return [row.path for row in chosen.where("choice = 'read'").select("path").orderBy("path").collect()]


def read_selected(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Read chosen files. One that turns out to be damaged stops the job."""
    return spark.read.option("ignoreCorruptFiles", False).parquet(*paths)


# ------------------------------------------------------------------- writing


def save(
    df: DataFrame,
    path: str,
    num_shards: int | None = None,
    compression: str = "gzip",
    key: str | None = None,
    metadata: DataFrame | None = None,
    seed: int = 42,
) -> None:
    """Write Parquet, optionally spread over ``num_shards`` random shards.

    With a ``key`` a draw decides the shard of a row, and the shard is the number in the
    file's name, so a retried task rewrites the same rows. Without one Spark deals
    the rows out in turn, and equal rows do not meet in one shard.
    """
    if num_shards is not None and key is not None:
        df = df.repartitionById(num_shards, F.floor(uniform(key, seed=seed) * num_shards).cast("int"))
    elif num_shards is not None:
        df = df.repartition(num_shards)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    if metadata is not None:
        metadata.write.mode("overwrite").parquet(path.rstrip("/") + METADATA_SUFFIX)


def save_split(df: DataFrame, path: str, split: str = "split", compression: str = "gzip") -> None:
    """One folder per part; a reader that filters on the part reads that folder only."""
    df.write.mode("overwrite").option("compression", compression).partitionBy(split).parquet(path)


def save_csv(df: DataFrame, path: str, missing: float | int | None = None) -> None:
    """CSV with a header; numeric NULLs are written as ``missing``."""
    df = df if missing is None else df.na.fill(missing)
    df.write.mode("overwrite").option("header", True).csv(path)


def save_binned(values: DataFrame, path: str) -> None:
    values.write.mode("overwrite").parquet(path)


def load_binned(spark: SparkSession, path: str, binning: Binning) -> DataFrame:
    """Per-bin values saved with their edges; fails unless they were made for this binning."""
    table = spark.read.parquet(path)
    stored = table.select("variable", "bin", "bin_lo", "bin_hi").orderBy("bin").collect()  # n_bins rows
    edges = [r.bin_lo for r in stored] + [stored[-1].bin_hi] if stored else []
    if not stored or not Binning(stored[0].variable, edges).same_as(binning):
        raise ValueError("the stored values belong to another binning")
    return table


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cache: in memory and on disk, or as a written table when a path is given."""
    if path is None:
        return df.persist()
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
