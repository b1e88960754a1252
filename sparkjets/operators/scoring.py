"""Scores: expressions, opaque batch functions and trained classifiers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BatchScorer = Callable[["object"], "object"]


def score_with_column(df: DataFrame, scorer: Callable[[DataFrame], Column], out: str = "score") -> DataFrame:
    return df.withColumn(out, scorer(df))


def score_in_batches(df: DataFrame, scorer: BatchScorer, out: str = "score") -> DataFrame:
    """Score with an opaque function from a pandas batch to a sequence of floats.

    Only used when the model is no Spark expression; partitions stay where they are.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            batch[out] = scorer(batch)
            yield batch

    return df.mapInPandas(run, schema)


def score_models(df: DataFrame, scorers: Mapping[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """One ``<name>_score`` column per model; features they share are computed once."""
    return df.withColumns({f"{name}_score": scorer(df) for name, scorer in scorers.items()})


def score_cache_path(folder: str, config: str, df: DataFrame | None = None) -> str:
    """Where the scores of a model configuration on the files and columns of ``df`` are kept.

    A filter or derived column that is not in the files must be named in ``config``.
    """
    data = [] if df is None else [*sorted(df.inputFiles()), df.schema.json()]
    key = hashlib.sha256("\n".join([config, *data]).encode()).hexdigest()
    return f"{folder.rstrip('/')}/{key}"


def cached_scores(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], folder: str, config: str) -> DataFrame:
    """Read the scores of this configuration if they were written, else compute and write them."""
    spark = df.sparkSession
    path = score_cache_path(folder, config, df)
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        scorer(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="_vector").transform(df)


def train_boosted_trees(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 5, seed=42):
    """Gradient-boosted trees on high-level features; returns a fitted model."""
    from pyspark.ml.classification import GBTClassifier

    learner = GBTClassifier(featuresCol="_vector", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return learner.fit(_assembled(df, features))


def train_dense(df: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (16,), epochs=50, seed=42):
    """Fully connected classifier on standardised high-level features; returns a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_vector", withMean=True),
        MultilayerPerceptronClassifier(
            featuresCol="_vector", labelCol=label, layers=[len(features), *hidden, 2], maxIter=epochs, seed=seed
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def apply_model(model, df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """Probability of class 1 from a fitted model."""
    from pyspark.ml.functions import vector_to_array

    ready = df if hasattr(model, "stages") else _assembled(df, features)
    scored = model.transform(ready).withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))
    return scored.drop("_raw", "_vector", "rawPrediction", "probability", "prediction")
