import pytest
from pyspark.sql import functions as F

from sparkjets import JetDataset
from sparkjets.functions.binning import Binning
from sparkjets.operators import combine, hist, weights
from sparkjets.sources import io
from sparkjets.streaming.ingest import ingest


@pytest.fixture(scope="module")
def events(spark):
    df = spark.range(100).select(
        F.col("id").alias("eventNumber"),
        F.array_repeat(F.col("id").cast("double"), (F.col("id") % 9 + 1).cast("int")).alias("feature1"),
        (F.col("id") % 10).cast("int").alias("label"),
        (F.col("id") % 3 + 1).cast("double").alias("weight"),
    )
    return JetDataset(df, {"num_events": 100.0})


def test_pick_remap_filter_length(events):
    ds = events.set_variables_target_weight(["eventNumber", "feature1[0]"], "label", "weight")
    assert ds.variables == ["eventNumber", "feature1[0]", "label", "weight"]
    half = ds.remap_labels(lambda x: (x > 4).cast("int"))
    assert half.df.agg(F.sum("label")).first()[0] == 50
    assert events.filter("eventNumber < 10").length == 10
    assert events.filter(lambda df: df.label == 3).length == 10
    mapped = events.remap_data(lambda df: {"double": df.weight * 2})
    assert mapped.variables == ["double"]
    assert events.apply(lambda df: df.limit(7)).length == 7
    with pytest.raises(ValueError):
        events.set_variables_target_weight(weight="weight")


def test_combine(events):
    both = JetDataset.combine([events, events])
    assert both.length == 200 and both.metadata == {"num_events": 200.0}
    other = JetDataset(events.df.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError):
        JetDataset.combine([events, other])
    shared = JetDataset.combine([events, other], mode="interleave", only_common=True)
    assert shared.length == 200 and "extra" not in shared.variables
    with pytest.raises(ValueError):
        JetDataset.combine([events], mode="nothing")


def test_sample_mix_quota(events):
    small = events.filter("eventNumber < 10")
    mix = JetDataset.combine([events, small], "sample", weights=[0.5, 0.5], key="eventNumber")
    assert mix.length == 20
    empty = events.filter("eventNumber < 0")
    assert JetDataset.combine([events, empty], "sample", weights=[0.5, 0.5], key="eventNumber").length == 0
    whole = JetDataset.combine([events, small], "sample", weights=[0.5, 0.5], key="eventNumber", stop_on_empty=False)
    assert whole.length == 110


def test_save_load(spark, events):
    path = io.shared_folder(spark)
    events.save(path, num_shards=3, key="eventNumber")
    back = JetDataset.load(spark, path)
    assert back.metadata == {"num_events": 100.0}
    assert sorted(back.df.collect()) == sorted(events.df.collect())
    many = JetDataset.load_multiple(spark, [path, path], labels=[0, 1])
    assert many.length == 200 and many.metadata == {"num_events": 200.0}
    assert many.df.where("file_label = 1").count() == 100
    few = JetDataset.load_parallel(spark, [path, path], take=5, order="eventNumber", labels=["a", "b"])
    assert few.length == 10


def test_load_parallel_checks_schemas(spark, events):
    a, b = io.shared_folder(spark), io.shared_folder(spark)
    events.save(a)
    events.df.withColumn("extra", F.lit(1)).write.parquet(b)
    with pytest.raises(ValueError):
        io.load_parallel(spark, [a, b])


@pytest.mark.parametrize("backend", ["cut", "coin"])
def test_split(events, backend):
    parts = events.split_train_dev_test(0.8, 0.1, 0.1, "eventNumber", backend)
    ids = [{r.eventNumber for r in p.df.collect()} for p in parts]
    assert set().union(*ids) == set(range(100)) and sum(len(i) for i in ids) == 100
    if backend == "cut":
        assert [len(i) for i in ids] == [80, 10, 10]


def test_exports(events):
    ds = events.set_variables_target_weight(["eventNumber"], "label")
    pdf = ds.to_pandas()
    assert sorted(pdf.columns) == ["eventNumber", "label", "weight"] and (pdf.weight == 1).all() and len(pdf) == 100
    arrays = events.to_numpy(["weight", "label"])
    assert arrays["weight"].shape == (100,) and set(arrays["label"]) == set(range(10))
    slashed = JetDataset(events.df.select(F.col("label").alias("a/b")))
    assert list(slashed.to_pandas().columns) == ["a.b"]


def test_prepare_batches(events):
    df = events.df.select("eventNumber", F.array(F.col("weight")).alias("node"))
    out = JetDataset(df).prepare(10, "eventNumber", ["node"], max_constituents=3, node="node", take=50).df
    rows = out.collect()
    assert sorted(r.size for r in rows) == [10] * 5
    assert all(len(n) == 3 for r in rows for n in r.node) and rows[0].mask[0] == [True, False, False]


def test_plot_data(events):
    b = Binning("eventNumber", 10, 0.0, 100.0)
    assert [r.value for r in events.histogram(b).orderBy("bin").collect()] == [10.0] * 10
    out = events.data_distributions([Binning("feature1", 4, 0.0, 100.0)])
    sums = out.groupBy("label").agg(F.sum("probability").alias("s")).collect()
    assert len(sums) == 10 and all(abs(r.s - 1) < 1e-9 for r in sums)
    assert events.single_variable(b, ["label"], stat="probability").count() == 100
    moments = events.apply(lambda df: df.select(F.struct("weight").alias("f"))).normalisation("f").first()
    assert moments["mean"] == pytest.approx(1.99)


def test_flat_weights(spark):
    counts = [100, 200, 300, 400, 500]
    rows = [(b,) for b, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "bin int")
    unit = weights.flat_weights(df, "bin", 5).orderBy("bin").collect()
    assert sum(r.w for r in unit) == pytest.approx(1.0)
    assert len({round(r.w * r.n, 9) for r in unit}) == 1
    total = weights.flat_weights(df, "bin", 5, "total").collect()
    assert sum(r.w for r in total) == pytest.approx(sum(counts))
    with pytest.raises(Exception, match="empty bin 5"):
        weights.flat_weights(df, "bin", 6).collect()
    with pytest.raises(ValueError):
        weights.flat_weights(df, "bin", 5, "other")


def test_stored_thresholds_need_their_binning(spark, data):
    from sparkjets.operators import metrics
    from sparkjets.sources import tables

    binning = Binning("jets_pt", [1000.005, 100000.005, 500000.005])
    path = io.shared_folder(spark)
    io.save_binned(metrics.bin_thresholds(tables.jets(spark, data), binning, "score", "label"), path)
    assert io.load_binned(spark, path, binning).count() == 2
    with pytest.raises(ValueError):
        io.load_binned(spark, path, Binning("jets_pt", [1000.005, 200000.005, 500000.005]))


def test_select_files(spark, events):
    path = io.shared_folder(spark)
    events.df.repartition(4).write.parquet(path)
    every = io.select_files(spark, path)
    assert len(every) == 4
    import os

    sizes = [os.path.getsize(p.replace("file:", "")) for p in every]
    assert len(io.select_files(spark, path, max_total_bytes=sizes[0] + sizes[1])) == 2
    assert io.select_files(spark, path, max_file_bytes=min(sizes) - 1) == []
    assert len(io.select_files(spark, path, max_total_rows=60)) == 2
    for name, content in (("broken", b"not parquet"), ("cut", open(every[0].replace("file:", ""), "rb").read()[:-9])):
        with open(f"{path}/part-{name}.parquet", "wb") as f:
            f.write(content)
    spark.createDataFrame([], events.df.schema).coalesce(1).write.mode("append").parquet(path)
    facts = {r.path.rsplit("-", 1)[-1] if r.state == "unreadable" else r.path: (r.rows, r.state) for r in io.file_facts(spark, path).collect()}
    assert [facts[p] for p in every] == [(25, "readable")] * 4
    assert [facts[f"{name}.parquet"] for name in ("broken", "cut")] == [(None, "unreadable")] * 2
    assert sorted(state for _, state in facts.values()).count("empty") == 1
    chosen = {r.path: r.choice for r in io.choose_files(io.file_facts(spark, path), max_total_rows=60).collect()}
    assert sorted(chosen.values()) == ["over budget"] * 2 + ["read"] * 3 + ["unreadable"] * 2
    some = io.select_files(spark, path)
    assert len(some) == 5 and io.read_selected(spark, some).count() == 100


def test_reading_in_a_random_order_samples_nothing(spark, events):
    path = io.shared_folder(spark)
    events.df.repartition(4).write.parquet(path)
    read = io.load(spark, path, shuffle_reading=True, seed=3)
    assert "rangepartitioning" not in read._jdf.queryExecution().toString().lower()
    rows = [tuple(r) for r in read.collect()]
    assert rows == [tuple(r) for r in io.load(spark, path, shuffle_reading=True, seed=3).collect()]
    assert rows != [tuple(r) for r in io.load(spark, path, shuffle_reading=True, seed=4).collect()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in events.df.collect())


def test_a_missing_norm_stops_the_job(spark):
    from sparkjets.operators import combine

    samples = spark.createDataFrame([("a", "sum_w"), ("b", "other")], "sample string, norm_name string")
    metadata = spark.createDataFrame([("a", "sum_w", 2.0), ("b", "sum_w", 3.0)], "sample string, key string, value double")
    with pytest.raises(Exception, match="no norm other of sample b"):
        combine.normalisation(samples, metadata).collect()
    assert {r.sample: r.norm for r in combine.normalisation(samples, metadata, missing="null").collect()} == {"a": 2.0, "b": None}


def test_ingest_resumes(spark, events):
    base = io.shared_folder(spark)
    source = f"{base}/in"
    events.df.select("eventNumber", "weight").repartition(3).write.parquet(source)
    args = dict(source=source, target=f"{base}/out", checkpoint=f"{base}/cp", to_int=["eventNumber"])
    first = ingest(spark, entry_id="eventNumber", entry_start=10, entry_stop=90, **args)
    assert first.count() == 80 and dict(first.dtypes)["eventNumber"] == "int"
    assert ingest(spark, entry_id="eventNumber", entry_start=10, entry_stop=90, **args).count() == 80
    events.df.select("eventNumber", "weight").limit(50).write.mode("append").parquet(source)
    again = ingest(spark, **args)
    assert again.count() == 130


def test_histogram_on_a_stream(spark, events):
    base = io.shared_folder(spark)
    events.df.select("eventNumber").repartition(2).write.parquet(f"{base}/in")
    rows = spark.readStream.schema("eventNumber long").parquet(f"{base}/in")
    out = hist.histogram_by(rows, Binning("eventNumber", 10, 0.0, 100.0))
    query = (
        out.writeStream.outputMode("complete").format("memory").queryName("stream_histogram")
        .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r.value for r in spark.table("stream_histogram").orderBy("bin").collect()] == [10.0] * 10


def test_shared_folder_follows_the_session(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert io.shared_folder(spark).startswith(base)


def test_metadata_sums(spark):
    long = spark.createDataFrame([("a", "k", 1.0), ("b", "k", 2.0), ("b", "m", 5.0)], "sample string, key string, value double")
    assert {r.key: r.value for r in combine.combine_metadata(long).collect()} == {"k": 3.0, "m": 5.0}


def test_equal_rows_are_spread_over_shards(spark):
    path = io.shared_folder(spark)
    io.save(spark.range(1000).select(F.lit(1).alias("x")), path, num_shards=4)
    sizes = [r.n for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and sum(sizes) == 1000 and max(sizes) <= 400


def test_take_first_beyond_one_task(spark, monkeypatch):
    from sparkjets.operators import split

    df = spark.range(5000).select(((F.col("id") * 37) % 1000).alias("x"), "id")
    small = [tuple(r) for r in split.take_first(df, 700, ["x", "id"]).collect()]
    monkeypatch.setattr(split, "DIRECT", 10)
    assert sorted(tuple(r) for r in split.take_first(df, 700, ["x", "id"]).collect()) == small
