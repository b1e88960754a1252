"""A DataFrame with its target, weight and metadata."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.functions.augment import augment
from sparkjets.functions.binning import Binning
from sparkjets.functions.features import add_features
from sparkjets.operators import combine, hist, nested, rank, select, split
from sparkjets.sources import io


@dataclass(frozen=True)
class JetDataset:
    """Immutable and lazy: every method returns a new object, only sinks and counts run a job."""

    df: DataFrame
    metadata: Mapping[str, float] = field(default_factory=dict)
    target: str | None = None
    weight: str | None = None

    # ------------------------------------------------------------- sources

    @classmethod
    def load(cls, spark: SparkSession, path: str, shuffle_reading: bool = False, key: str | None = None):
        df = io.load(spark, path, shuffle_reading, key)
        try:
            rows = io.load_metadata(spark, path).collect()  # one row per metadata key
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = []
        return cls(df, {r["key"]: r["value"] for r in rows})

    @classmethod
    def load_multiple(cls, spark, paths: Sequence[str], mode="concatenate", **options):
        parts = [cls.load(spark, p).metadata for p in paths]
        return cls(io.load_multiple(spark, paths, mode=mode, **options), _sum_metadata(parts))

    @classmethod
    def load_parallel(cls, spark, paths: Sequence[str], **options):
        parts = [cls.load(spark, p).metadata for p in paths]
        return cls(io.load_parallel(spark, paths, **options), _sum_metadata(parts))

    @classmethod
    def from_dataframe(cls, df: DataFrame, metadata: Mapping[str, float] | None = None):
        return cls(df, dict(metadata or {}))

    @classmethod
    def from_event_files(cls, spark, path: str, file_format: str = "parquet", **options):
        return cls(io.normalise_schema(spark.read.format(file_format).load(path), **options))

    @classmethod
    def combine(
        cls,
        datasets: Sequence["JetDataset"],
        mode: str = "concatenate",
        weights: Sequence[float] | None = None,
        key: str | None = None,
        stop_on_empty: bool = True,
        only_common: bool = False,
        metadata_combiner: Callable[[Sequence[Mapping]], Mapping] | None = None,
    ):
        frames = [d.df for d in datasets]
        if mode == "sample":
            df = combine.sample_mix(frames, key or "", weights, stop_on_empty, only_common=only_common)
        elif mode in ("concatenate", "interleave"):
            df = combine.concatenate(frames, only_common)
        else:
            raise ValueError(f"unknown mode {mode!r}")
        return cls(df, (metadata_combiner or _sum_metadata)([d.metadata for d in datasets]))

    # -------------------------------------------------------- inspection

    @property
    def variables(self) -> list[str]:
        return select.variables(self.df)

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def length(self) -> int:
        return self.df.count()

    # -------------------------------------------------- transformations

    def with_df(self, df: DataFrame) -> "JetDataset":
        return replace(self, df=df)

    def apply(self, fn: Callable[[DataFrame], DataFrame]) -> "JetDataset":
        return self.with_df(self.df.transform(fn))

    def remap_data(self, fn: Callable[[DataFrame], Mapping[str, Column]]) -> "JetDataset":
        return self.with_df(select.map_columns(self.df, fn))

    def remap_labels(self, fn: Callable[[Column], Column]) -> "JetDataset":
        return self.with_df(select.remap_labels(self.df, fn))

    def filter(self, condition) -> "JetDataset":
        return self.with_df(select.where(self.df, condition))

    def set_variables_target_weight(self, variables=None, target=None, weight=None) -> "JetDataset":
        if weight is not None and target is None:
            raise ValueError("a weight needs a target")
        return replace(self, df=select.pick(self.df, variables, target, weight), target=target, weight=weight)

    def flatten(self, **options) -> "JetDataset":
        return self.with_df(nested.flatten_events(self.df, **options))

    def augment(self, key: str, steps, seed: int = 42) -> "JetDataset":
        return self.with_df(augment(self.df, key, steps, seed))

    def features(self, name: str, out: str = "features", **options) -> "JetDataset":
        return self.with_df(add_features(self.df, name, out, **options))

    def take(self, n: int, order: Sequence[str]) -> "JetDataset":
        return self.with_df(split.take_first(self.df, n, order))

    def shuffle(self, key: str, seed: int = 42) -> "JetDataset":
        return self.with_df(split.shuffle(self.df, key, seed))

    def cache(self, path: str | None = None) -> "JetDataset":
        return self.with_df(io.materialise(self.df, path))

    def split_train_dev_test(self, train: float, dev: float, test: float, key: str, backend="cut", seed=42):
        """Three datasets. ``cut`` slices the order of ``key``, ``coin`` draws once per row.

        The cut is made once and written to the shared folder by part; each dataset reads its own.
        """
        parts = {"train": train, "dev": dev, "test": test}
        if backend not in ("cut", "coin"):
            raise ValueError(f"unknown backend {backend!r}")
        if backend == "cut":
            path = io.shared_folder(self.df.sparkSession)
            io.save_split(split.split_contiguous(self.df, parts, key, "_split"), path, "_split", "snappy")
            kinds = T.StructType([*self.df.schema.fields, T.StructField("_split", T.StringType())])
            tagged = self.df.sparkSession.read.schema(kinds).parquet(path)
        else:
            tagged = split.split_random(self.df, parts, key, "_split", seed)
        return tuple(self.with_df(tagged.where(F.col("_split") == p).drop("_split")) for p in parts)

    def prepare(
        self, batch_size: int, order: str, columns: Sequence[str], max_constituents: int | None = None,
        pad_value: float = 0.0, node: str | None = None, edge: str | None = None, take: int | None = None,
        shuffle_seed: int | None = None,
    ) -> "JetDataset":
        """Batches, padded to ``max_constituents`` when a node or edge column is named."""
        df = self.df
        if node or edge:
            if max_constituents is None:
                raise ValueError("name the size that records are padded to")
            df = nested.pad_records(df, max_constituents, pad_value, node, edge)
            columns = [*columns, "mask"]
        return self.with_df(split.batches(df, batch_size, order, columns, shuffle_seed, take))

    # ---------------------------------------------------- plot data, exports

    def histogram(self, binning: Binning | Sequence[Binning], weight: str | None = None) -> DataFrame:
        if isinstance(binning, Binning):
            return hist.histogram(self.df, binning, weight)
        return hist.histogram_multiple(self.df, binning, weight)

    def data_distributions(self, binnings: Sequence[Binning], label="label", weight=None) -> DataFrame:
        exploded = nested.explode_to_scalars(self.df, [b.variable for b in binnings])
        return hist.class_histograms(exploded, binnings, label, weight)

    def single_variable(self, binning: Binning, hue: Sequence[str] = (), weight=None, stat="count", common_norm=False):
        return hist.histogram_by(self.df, binning, hue, weight, stat, common_norm)

    def normalisation(self, features: str) -> DataFrame:
        return rank.feature_moments(self.df, features)

    def to_pandas(self, variables: Sequence[str] | None = None):
        return select.to_table(self.df, variables).toPandas()

    def to_numpy(self, variables: Sequence[str]) -> dict:
        table = self.df.select(*variables).toArrow()
        return {name: table.column(name).to_numpy(zero_copy_only=False) for name in variables}

    def save(self, path: str, num_shards: int | None = None, key: str | None = None) -> None:
        metadata = None
        if self.metadata:
            rows = [(k, float(v)) for k, v in self.metadata.items()]
            metadata = self.df.sparkSession.createDataFrame(rows, "key string, value double")
        io.save(self.df, path, num_shards, key=key, metadata=metadata)


def _sum_metadata(parts: Sequence[Mapping[str, float]]) -> dict[str, float]:
    total: dict[str, float] = {}
    for part in parts:
        for key, value in part.items():
            total[key] = total.get(key, 0.0) + value
    return total
