"""Readers, writers and the streaming ingest: what is written comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjets import JetDataset
from sparkjets.catalog.base import R, draw, order_draw, query, r
from sparkjets.functions.arrays import one_hot
from sparkjets.operators import combine, nested, select, split
from sparkjets.operators.nested import nest
from sparkjets.operators.ordered import number_rows
from sparkjets.sources import io, tables
from sparkjets.streaming import ingest as stream

jets = tables.jets


@query("save_and_load_dataset", f"SELECT jet_id, {R('jets_pt')} AS jets_pt, label, 15::DOUBLE AS lumi FROM jets")
def save_and_load_dataset(spark, d):
    path = io.shared_folder(spark)
    JetDataset(jets(spark, d), {"lumi": 15.0}).save(path, num_shards=4, key="jet_id")
    back = JetDataset.load(spark, path)
    return back.df.select("jet_id", r("jets_pt").alias("jets_pt"), "label", F.lit(back.metadata["lumi"]).alias("lumi"))


@query(
    "shuffled_reading",
    f"SELECT o_orderkey, row_number() OVER (ORDER BY {order_draw(42, 'o_orderkey')}) AS place FROM orders",
    (),
)
def shuffled_reading(spark, d):
    """The place of every row in the order in which they are read."""
    df = io.load(spark, f"{d}/orders.parquet", shuffle_reading=True, key="o_orderkey").select("o_orderkey")
    return number_rows(df.withColumn("_at", F.monotonically_increasing_id()), "_at", "place").select("o_orderkey", "place")


@query(
    "load_multiple_with_labels",
    """SELECT c_custkey AS id, c_acctbal AS balance, 'customer' AS file_label FROM customer WHERE c_acctbal > 0
        UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier WHERE s_acctbal > 0""",
    (),
)
def load_multiple_with_labels(spark, d):
    def common(df, label):
        p = label[0]
        key = {"customer": "c_custkey", "supplier": "s_suppkey"}[label]
        return df.select(F.col(key).alias("id"), F.col(f"{p}_acctbal").alias("balance"))

    names = ["customer", "supplier"]
    return io.load_multiple(
        spark, [f"{d}/{n}.parquet" for n in names], names, common, lambda df, _: df.where("balance > 0"), only_common=True
    )


@query(
    "load_parallel_take_per_file",
    """SELECT jet_id, generator AS file_label FROM (SELECT jet_id, generator, row_number() OVER (PARTITION BY generator
        ORDER BY jet_id) AS nth FROM jets) WHERE nth <= 1000""",
)
def load_parallel_take_per_file(spark, d):
    path = io.shared_folder(spark)
    io.save_split(jets(spark, d).select("jet_id", "generator"), path, "generator")
    folders = [f"{path}/generator={g}" for g in "FOP"]
    return io.load_parallel(spark, folders, take=1000, order="jet_id", labels=list("FOP")).select("jet_id", "file_label")


@query("wrap_dataframe", "SELECT label, count(*) AS n FROM jets WHERE jets_pt > 50000e0 GROUP BY label")
def wrap_dataframe(spark, d):
    return JetDataset.from_dataframe(jets(spark, d)).filter("jets_pt > 50_000").df.groupBy("label").agg(
        F.count("*").alias("n")
    )


@query(
    "ingest_nested_schema",
    f"SELECT jet_id::INT AS jet_id, count(*)::INT AS n, 2::INT AS arrays, {R('max(pt)::FLOAT::DOUBLE', 2)} AS lead FROM lead GROUP BY jet_id",
    ("lead",),
)
def ingest_nested_schema(spark, d):
    """Arrays that are empty everywhere go; doubles and longs are narrowed."""
    df = tables.nested_constituents(spark, d).select("jet_id", "jets_Constituent_pt", "jets_Constituent_m")
    df = df.withColumn("jets_empty", F.array().cast("array<double>"))
    clean = io.normalise_schema(df, downcast=True)
    arrays = sum(kind.startswith("array<float>") for _, kind in clean.dtypes)
    return clean.select(
        "jet_id",
        F.size("jets_Constituent_pt").alias("n"),
        F.lit(arrays).alias("arrays"),
        r(F.get("jets_Constituent_pt", F.lit(0)).cast("double"), 2).alias("lead"),
    )


@query(
    "long_to_nested",
    f"""SELECT jet_id, count(*)::INT AS n, {R('sum((idx + 1) * pt)', 2)} AS ordered_sum, {R('min(pt)')} AS last_pt
        FROM lead GROUP BY jet_id""",
    ("lead",),
)
def long_to_nested(spark, d):
    df = tables.nested_constituents(spark, d)
    pt = F.col("jets_Constituent_pt")
    ordered = F.aggregate(F.transform(pt, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select(
        "jet_id", F.size(pt).alias("n"), r(ordered, 2).alias("ordered_sum"), r(F.try_element_at(pt, F.lit(-1))).alias("last_pt")
    )


@query(
    "long_to_segments",
    f"""WITH s AS (SELECT l_suppkey, pt, row_number() OVER (PARTITION BY l_suppkey ORDER BY pt DESC, jet_id, l_linenumber, l_partkey, phi, eta, m) - 1 AS idx
            FROM cons)
        SELECT l_suppkey, count(*) AS n, {R('sum((idx + 1) * pt) / 1e6', 4)} AS ordered_sum, max(idx // 50 + 1)::BIGINT AS segments,
            {R('sum(CASE WHEN idx < 70 THEN pt END)', 2)} AS leading FROM s GROUP BY l_suppkey""",
    ("cons",),
)
def long_to_segments(spark, d):
    """Items of a supplier nested in segments of fifty: counts, an ordered sum and the first seventy."""
    rows = tables.constituents(spark, d).withColumn("minus", -F.col("pt"))
    ties = ["jet_id", "l_linenumber", "l_partkey", "phi", "eta", "m"]
    segments = nested.nest_segments(rows, ["l_suppkey"], "minus", {"pt": "pt"}, ties, 50)
    weighted = F.aggregate(F.transform("pt", lambda x, i: x * (F.col("start") + i + 1)), F.lit(0.0), lambda a, x: a + x)
    sums = nested.segment_totals(segments, ["l_suppkey"], {"n": F.size("pt"), "ordered_sum": weighted, "segments": F.lit(1)})
    first = nested.first_of_segments(segments, 70, ["pt"])
    leading = nested.segment_totals(first, ["l_suppkey"], {"leading": F.aggregate("pt", F.lit(0.0), lambda a, x: a + x)})
    return sums.join(leading, "l_suppkey").select("l_suppkey", "n", r(F.col("ordered_sum") / 1e6, 4).alias("ordered_sum"), "segments", r("leading", 2).alias("leading"))


@query(
    "stream_ingest",
    "SELECT event_id, user_id::INT AS user_id, value::FLOAT AS value, event_type FROM events",
    (),
)
def stream_ingest(spark, d):
    base = io.shared_folder(spark)
    out = stream.ingest(
        spark, d, f"{base}/out", f"{base}/checkpoint",
        schema=tables.table(spark, d, "events").schema,
        to_int=["user_id"], to_float=["value"], pattern="events.parquet",
    )
    return out.select("event_id", "user_id", "value", "event_type")


@query("materialise_and_count", "SELECT count(*) AS n FROM jets")
def materialise_and_count(spark, d):
    df = io.materialise(jets(spark, d), io.shared_folder(spark))
    expected = tables.table(spark, d, "orders").count()
    return split.has_rows(df, expected)


@query(
    "valid_slots_zipped",
    f"""SELECT jet_id, {R('jets_pt')} AS jets_pt, count(CASE WHEN l_returnflag = 'R' THEN 1 END)::INT AS n_valid,
        {R("coalesce(sum(CASE WHEN l_returnflag = 'R' THEN pt END), 0e0)", 2)} AS pt_valid
        FROM lead JOIN jets USING (jet_id) GROUP BY jet_id, jets_pt""",
    ("lead", "jets"),
)
def valid_slots_zipped(spark, d):
    """A table of masked slots, reduced to its valid entries and zipped with the scalar table on the row id."""
    rows = tables.constituents(spark, d).withColumn("valid", F.col("l_returnflag") == "R")
    order = [F.col("pt").desc(), *[F.col(c) for c in tables.CONSTITUENT_ORDER[1:]]]
    slots = nest(rows, ["jet_id"], order, {"pt": "pt", "valid": "valid"})
    kept = io.valid_slots(slots.select("jet_id", F.arrays_zip("pt", "valid").alias("slots")), "slots")
    total = F.aggregate("slots", F.lit(0.0), lambda a, x: a + x["pt"])
    both = combine.zip_rows(jets(spark, d).select("jet_id", "jets_pt"), kept, "jet_id")
    return both.select("jet_id", r("jets_pt").alias("jets_pt"), F.size("slots").alias("n_valid"), r(total, 2).alias("pt_valid"))


@query(
    "csv_round_trip_with_fill",
    f"SELECT jet_id, coalesce(label, -1)::INT AS label, {R('score')} AS score FROM jets",
)
def csv_round_trip_with_fill(spark, d):
    path = io.shared_folder(spark)
    io.save_csv(jets(spark, d).select("jet_id", "label", "score"), path, missing=-1)
    return io.read_csv(spark, path, "jet_id long, label int, score double").select("jet_id", "label", r("score").alias("score"))


@query(
    "csv_tagged_by_path",
    f"SELECT generator AS dir, slice::VARCHAR AS model, count(*) AS n, {R('sum(score)', 4)} AS score FROM jets GROUP BY 1, 2",
)
def csv_tagged_by_path(spark, d):
    path = io.shared_folder(spark)
    named = jets(spark, d).select("jet_id", "score", F.col("generator").alias("dir"), F.col("slice").alias("model"))
    named.write.option("header", True).partitionBy("dir", "model").csv(path)
    out = io.read_tagged_csv(
        spark, f"{path}/*/*/*.csv", r"dir=(\w+)/model=(\w+)/", ["dir", "model"], "jet_id long, score double"
    )
    return out.groupBy("dir", "model").agg(F.count("*").alias("n"), r(F.sum("score"), 4).alias("score"))


def shard_of_file():
    """The number in a file's name, which is the shard."""
    return F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("long")


@query("save_in_shards", f"SELECT jet_id, floor({draw(42, 'jet_id')} * 8)::BIGINT AS shard, {R('jets_pt')} AS jets_pt, label FROM jets")
def save_in_shards(spark, d):
    """Every row, and the file it was written to."""
    path = io.shared_folder(spark)
    io.save(jets(spark, d), path, num_shards=8, key="jet_id")
    return spark.read.parquet(path).select("jet_id", shard_of_file().alias("shard"), r("jets_pt").alias("jets_pt"), "label")


@query(
    "export_flat_table",
    f'SELECT {R("jets_pt")} AS jets_pt, slice, (slice - 1)::INT AS label, 1e0 AS weight FROM jets',
)
def export_flat_table(spark, d):
    """A feature struct and a one-hot label become flat columns, an index and the default weight."""
    df = jets(spark, d).select(F.struct("jets_pt", "slice").alias("features"), one_hot(F.col("slice") - 1, 5).alias("label"))
    return select.to_table(df).withColumn("jets_pt", r("jets_pt"))


@query("binned_values_stored", "SELECT slice AS bin, count(*) AS n FROM jets GROUP BY slice")
def binned_values_stored(spark, d):
    path = io.shared_folder(spark)
    io.save_binned(jets(spark, d).groupBy(F.col("slice").alias("bin")).agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query("selected_files", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1", ())
def selected_files(spark, d):
    """Files by their footers: none over a terabyte, all within the total budget."""
    paths = io.select_files(spark, d, "orders.parquet", max_file_bytes=1 << 40, max_total_bytes=1 << 50)
    return io.read_selected(spark, paths).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(
    "files_within_row_budget",
    f"""WITH s AS (SELECT shard, count(*) AS n FROM (SELECT floor({draw(42, 'jet_id')} * 12)::BIGINT AS shard FROM jets) GROUP BY shard),
        t AS (SELECT *, sum(n) OVER (ORDER BY shard)::BIGINT AS total FROM s)
        SELECT shard, n AS rows, CASE WHEN total > (SELECT count(*) FROM jets) // 2 THEN 'over budget' ELSE 'read' END AS choice FROM t""",
)
def files_within_row_budget(spark, d):
    """The twelve files of a dataset, of which those are read that hold half of the rows together at most."""
    df, path = jets(spark, d).select("jet_id"), io.shared_folder(spark)
    io.save(df, path, num_shards=12, key="jet_id")
    half = spark.read.parquet(path).count() // 2
    chosen = io.choose_files(io.file_facts(spark, path), max_total_rows=half)
    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    return chosen.select(shard.alias("shard"), "rows", "choice")


@query(
    "split_folders",
    """WITH n AS (SELECT jet_id, row_number() OVER (ORDER BY jet_id) AS nth, count(*) OVER () AS c FROM jets)
        SELECT jet_id FROM n WHERE nth > floor(c * 0.8e0) AND nth <= floor(c * 0.8e0) + floor(c * 0.1e0)""",
)
def split_folders(spark, d):
    path = io.shared_folder(spark)
    parts = {"train": 0.8, "dev": 0.1, "test": 0.1}
    io.save_split(split.split_contiguous(jets(spark, d), parts, "jet_id"), path)
    return spark.read.parquet(path).where("split = 'dev'").select("jet_id")


@query(
    "union_of_files_by_pattern",
    f"SELECT generator, count(*) AS n, {R('sum(jets_pt)', 1)} AS pt FROM jets GROUP BY generator",
)
def union_of_files_by_pattern(spark, d):
    path = io.shared_folder(spark)
    for g in "FOP":
        io.save(jets(spark, d).where(F.col("generator") == g), f"{path}/jets_{g}")
    return (
        io.load(spark, f"{path}/jets_*").groupBy("generator").agg(F.count("*").alias("n"), r(F.sum("jets_pt"), 1).alias("pt"))
    )


@query("cached_rows", "SELECT jet_id, slice FROM jets")
def cached_rows(spark, d):
    return io.materialise(jets(spark, d).select("jet_id", "slice"), io.shared_folder(spark))


@query(
    "zip_by_row_id",
    f"SELECT jet_id, {R('jets_pt')} AS jets_pt, n FROM jets JOIN (SELECT jet_id, count(*) AS n FROM cons GROUP BY 1) USING (jet_id)",
    ("jets", "cons"),
)
def zip_by_row_id(spark, d):
    counts = tables.constituents(spark, d).groupBy("jet_id").agg(F.count("*").alias("n"))
    both = combine.zip_rows(jets(spark, d).select("jet_id", "jets_pt"), counts, "jet_id")
    return both.select("jet_id", r("jets_pt").alias("jets_pt"), "n")


@query(
    "flatten_and_save_shards",
    f"""SELECT jet_id AS jets_id, event_id, parton AS jets_parton, floor({draw(42, 'jet_id')} * 4)::BIGINT AS shard, {R('jets_pt')} AS jets_pt
        FROM ejets WHERE parton <> -1""",
    ("ejets",),
)
def flatten_and_save_shards(spark, d):
    """Every jet of a flattened dataset, and the file it was written to."""
    path = io.shared_folder(spark)
    flat = nested.flatten_events(tables.events_nested(spark, d), "jets_parton", [1, 2, 3, 4, 5, 6, 21])
    io.save(flat, path, num_shards=4, key="jets_id")
    return io.load(spark, path).select("jets_id", "event_id", "jets_parton", shard_of_file().alias("shard"), r("jets_pt").alias("jets_pt"))
