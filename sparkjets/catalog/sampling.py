"""Order, splits, batches, resampling, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjets.catalog.aggregations import CLASS_BIN, PT, PT_BIN, pt_bin
from sparkjets.catalog.base import R, case_bins, draw, order_draw, query, r
from sparkjets.functions.binning import Binning
from sparkjets.functions.random import uniform
from sparkjets.operators import combine, resample, split
from sparkjets.operators.ordered import number_rows
from sparkjets.sources import io, tables
from sparkjets.streaming import resample as stream

jets = tables.jets


@query(
    "min_count_resampling",
    f"""WITH b AS (SELECT jet_id, {PT_BIN} AS bin FROM jets), n AS (SELECT bin, row_number() OVER (PARTITION BY bin ORDER BY jet_id)
            AS nth, jet_id FROM b), c AS (SELECT count(*) AS c FROM b GROUP BY bin)
        SELECT jet_id, bin FROM n WHERE nth < (SELECT min(c) FROM c)""",
)
def min_count_resampling(spark, d):
    binned = jets(spark, d).withColumn("bin", pt_bin())
    return resample.keep_min_count(binned, "bin", PT.n_bins, "jet_id").select("jet_id", "bin")


@query(
    "min_count_resampling_by_class",
    f"""WITH b AS (SELECT jet_id, {CLASS_BIN} AS bin FROM jets WHERE parton <> -1), n AS (SELECT bin, jet_id,
            row_number() OVER (PARTITION BY bin ORDER BY jet_id) AS nth FROM b), c AS (SELECT count(*) AS c FROM b GROUP BY bin)
        SELECT jet_id FROM n WHERE nth < (SELECT min(c) FROM c)""",
)
def min_count_resampling_by_class(spark, d):
    known = jets(spark, d).where("parton <> -1")
    return resample.resample_variable_by_class(known, PT, "parton", "jet_id", from_min_count=True).select("jet_id")


@query("take_first_rows", "SELECT jet_id, jets_pt FROM jets ORDER BY jets_pt DESC, jet_id LIMIT 500")
def take_first_rows(spark, d):
    df = jets(spark, d).withColumn("minus", -F.col("jets_pt"))
    return split.take_first(df, 500, ["minus", "jet_id"]).select("jet_id", "jets_pt")


@query(
    "contiguous_split",
    """WITH n AS (SELECT jet_id, row_number() OVER (ORDER BY jet_id) AS nth, count(*) OVER () AS c FROM jets)
        SELECT jet_id, CASE WHEN nth <= floor(c * 0.8e0) THEN 'train' WHEN nth <= floor(c * 0.8e0) + floor(c * 0.15e0) THEN 'dev'
            ELSE 'test' END AS split FROM n""",
)
def contiguous_split(spark, d):
    parts = {"train": 0.8, "dev": 0.15, "test": 0.05}
    return split.split_contiguous(jets(spark, d), parts, "jet_id").select("jet_id", "split")


@query(
    "random_split",
    f"""SELECT jet_id, CASE WHEN u <= 0.7e0 THEN 'train' WHEN u <= 0.7e0 + 0.2e0 THEN 'dev' ELSE 'test' END AS split
        FROM (SELECT jet_id, {draw(42, 'jet_id')} AS u FROM jets)""",
)
def random_split(spark, d):
    parts = {"train": 0.7, "dev": 0.2, "test": 0.1}
    return split.split_random(jets(spark, d), parts, "jet_id").select("jet_id", "split")


@query("shuffled_rows", f"SELECT jet_id, row_number() OVER (ORDER BY {order_draw(42, 'jet_id')}) AS place FROM jets")
def shuffled_rows(spark, d):
    """The place of every row in the order in which the shuffled rows come."""
    ordered = split.shuffle(jets(spark, d).select("jet_id"), "jet_id").withColumn("_at", F.monotonically_increasing_id())
    return number_rows(ordered, "_at", "place").select("jet_id", "place")


RESHUFFLES = 5


@query(
    "reshuffled_files",
    f"""SELECT floor({draw(42 + RESHUFFLES - 1, 'jet_id')} * 8)::BIGINT AS shard, count(*) AS n, sum(jet_id)::BIGINT AS ids,
        {R('sum(jets_pt)', 1)} AS pt FROM jets GROUP BY 1""",
)
def reshuffled_files(spark, d):
    """What lies in each file after five passes, each from the files of the one before with a seed of its own."""
    df = jets(spark, d).select("jet_id", "jets_pt")
    for turn in range(RESHUFFLES):
        path = io.shared_folder(spark)
        io.save(df, path, num_shards=8, key="jet_id", seed=42 + turn)
        df = io.load(spark, path)
    shard = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("long")
    return df.groupBy(shard.alias("shard")).agg(
        F.count("*").alias("n"), F.sum("jet_id").alias("ids"), r(F.sum("jets_pt"), 1).alias("pt")
    )


@query(
    "sorted_by_metric",
    f"""WITH s AS (SELECT slice, avg(score) AS m FROM jets GROUP BY slice)
        SELECT slice, {R('m')} AS metric FROM s ORDER BY m DESC""",
)
def sorted_by_metric(spark, d):
    means = jets(spark, d).groupBy("slice").agg(F.avg("score").alias("m"))
    return means.orderBy(F.col("m").desc()).select("slice", r("m").alias("metric"))


@query(
    "fixed_size_batches",
    f"""WITH n AS (SELECT *, (row_number() OVER (ORDER BY jet_id) - 1) // 512 AS batch FROM jets)
        SELECT batch, count(*)::INT AS size, {R('sum(jets_pt)', 2)} AS pt, min(jet_id) AS first_id FROM n GROUP BY batch""",
)
def fixed_size_batches(spark, d):
    out = split.batches(jets(spark, d), 512, "jet_id", ["jet_id", "jets_pt"])
    total = F.aggregate("jets_pt", F.lit(0.0), lambda a, x: a + x)
    return out.select("batch", "size", r(total, 2).alias("pt"), F.get("jet_id", F.lit(0)).alias("first_id"))


@query("shuffled_batches", "SELECT count(*) AS batches, sum(n)::BIGINT AS rows, sum(ids)::BIGINT AS ids FROM (SELECT count(*) AS n, "
       "sum(jet_id) AS ids FROM (SELECT jet_id, (row_number() OVER (ORDER BY jet_id) - 1) // 256 AS b FROM jets) GROUP BY b)")
def shuffled_batches(spark, d):
    """Every row lands in exactly one batch, whatever the order."""
    out = split.batches(jets(spark, d), 256, "jet_id", ["jet_id"], shuffle_seed=7)
    ids = F.aggregate("jet_id", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.agg(F.count("*").alias("batches"), F.sum("size").alias("rows"), F.sum(ids).alias("ids"))


def _rejection_sql(shares) -> str:
    literal = "[" + ", ".join(f"{x!r}::DOUBLE" for x in shares) + "]"
    return f"""WITH b AS (SELECT jet_id, {PT_BIN} AS bin FROM jets), c AS (SELECT bin, {literal}[bin + 1] / count(*) AS r FROM b GROUP BY bin)
        SELECT jet_id, bin FROM b JOIN c USING (bin) WHERE {draw(42, 'jet_id')} < r / (SELECT max(r) FROM c)"""


@query("rejection_resampling_flat", _rejection_sql([1.0 / PT.n_bins] * PT.n_bins))
def rejection_resampling_flat(spark, d):
    """Rows accepted so that every bin holds about as many as the smallest."""
    binned = jets(spark, d).withColumn("bin", pt_bin())
    return resample.rejection_resample(binned, "bin", PT.n_bins, "jet_id").select("jet_id", "bin")


TARGET = [0.25, 0.2, 0.15, 0.1, 0.1, 0.1, 0.1]


@query("rejection_resampling_target", _rejection_sql(TARGET))
def rejection_resampling_target(spark, d):
    """Rows accepted so that the bins follow a target distribution."""
    binned = jets(spark, d).withColumn("bin", pt_bin())
    return resample.rejection_resample(binned, "bin", PT.n_bins, "jet_id", TARGET).select("jet_id", "bin")


STREAM_PARTS = 4


@query(
    "resampled_stream",
    f"""WITH b AS (SELECT jet_id, {PT_BIN} AS bin, floor({draw(7, 'jet_id')} * {STREAM_PARTS})::INT AS part FROM jets),
        c AS (SELECT p.part, b.bin, count(*) AS n FROM range({STREAM_PARTS}) p(part) JOIN b ON b.part <= p.part GROUP BY 1, 2),
        a AS (SELECT part, bin, {TARGET!r}[bin + 1]::DOUBLE / n AS r, max({TARGET!r}[bin + 1]::DOUBLE / n) OVER (PARTITION BY part) AS top FROM c)
        SELECT part, jet_id, bin FROM b JOIN a USING (part, bin) WHERE {draw(42, 'jet_id')} < r / top""",
)
def resampled_stream(spark, d):
    """Four files come one after the other; each is resampled by the counts of all until then."""
    base = io.shared_folder(spark)
    binned = jets(spark, d).select("jet_id", pt_bin().alias("bin"), F.floor(uniform("jet_id", seed=7) * STREAM_PARTS).cast("int").alias("part"))
    for part in range(STREAM_PARTS):
        binned.where(F.col("part") == part).coalesce(1).write.parquet(f"{base}/in/part{part}")
    rows = spark.readStream.schema(binned.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    kept = stream.resample_stream(rows, "bin", PT.n_bins, "jet_id", f"{base}/out", f"{base}/state", f"{base}/checkpoint", TARGET)
    return kept.select("part", "jet_id", "bin")


HALVES = Binning("jets_pt", [1000.005, 250000.005, 500000.005])
SIDES = Binning("jets_eta", [-4.505, -0.005, 4.505])
CELL = f"({case_bins('jets_pt', HALVES.edges)} * 2 + {case_bins('jets_eta', SIDES.edges)})"


def _weights_sql(index: str) -> str:
    return f"""WITH b AS (SELECT jet_id, {index} AS bin FROM jets), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
        w AS (SELECT bin, (1e0 / n) / (SELECT sum(1e0 / n) FROM c) AS w FROM c)
        SELECT jet_id, {R('w', 9)} AS flat FROM b JOIN w USING (bin)"""


@query("flat_weights_one_variable", _weights_sql(PT_BIN))
def flat_weights_one_variable(spark, d):
    return resample.resample_variable(jets(spark, d), PT, "jet_id", weight="flat").select("jet_id", r("flat", 9).alias("flat"))


@query("flat_weights_two_variables", _weights_sql(CELL))
def flat_weights_two_variables(spark, d):
    out = resample.resample_two_variables(jets(spark, d), HALVES, SIDES, "jet_id", weight="flat")
    return out.select("jet_id", r("flat", 9).alias("flat"))


@query(
    "flat_weights_two_variables_by_class",
    _weights_sql(f"(CASE WHEN parton BETWEEN 1 AND 6 THEN {CELL} WHEN parton = 21 THEN {CELL} + 4 ELSE 0 END)"),
)
def flat_weights_two_variables_by_class(spark, d):
    out = resample.resample_two_variables_by_class(jets(spark, d), HALVES, SIDES, "parton", "jet_id", weight="flat")
    return out.select("jet_id", r("flat", 9).alias("flat"))


@query("flat_weights_labels", _weights_sql("(parton BETWEEN 1 AND 6)::INT"))
def flat_weights_labels(spark, d):
    out = resample.resample_labels(jets(spark, d), "parton", "jet_id", weight="flat")
    return out.select("jet_id", r("flat", 9).alias("flat"))


@query(
    "balanced_classes",
    """WITH c AS (SELECT label, count(*) AS n FROM jets WHERE label IS NOT NULL GROUP BY label)
        SELECT label, (SELECT min(n) FROM c) AS n, (SELECT min(n) FROM c) AS distinct_n FROM c""",
)
def balanced_classes(spark, d):
    out = resample.balanced_classes(jets(spark, d), "label", [0, 1], "jet_id")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("jet_id").alias("distinct_n"))


# ---------------------------------------------------------------------- unions


def accounts(spark, d):
    """Customers and suppliers as two datasets with some common columns."""
    customer = tables.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), "c_mktsegment"
    )
    supplier = tables.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), "s_name"
    )
    return customer, supplier


ACCOUNTS = """SELECT c_custkey AS id, c_acctbal AS balance, c_nationkey AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier"""


@query("union_common_columns", ACCOUNTS, ())
def union_common_columns(spark, d):
    return combine.concatenate(accounts(spark, d), only_common=True)


@query(
    "concatenate_datasets",
    "SELECT jet_id, generator FROM jets WHERE generator = 'F' UNION ALL SELECT jet_id, generator FROM jets WHERE generator = 'O'",
)
def concatenate_datasets(spark, d):
    df = jets(spark, d).select("jet_id", "generator")
    return combine.concatenate([df.where("generator = 'F'"), df.where("generator = 'O'")])


@query("interleave_datasets", "SELECT jet_id, slice FROM jets WHERE slice IN (1, 3)")
def interleave_datasets(spark, d):
    from sparkjets import JetDataset

    df = jets(spark, d).select("jet_id", "slice")
    parts = [JetDataset.from_dataframe(df.where(F.col("slice") == s)) for s in (1, 3)]
    return JetDataset.combine(parts, mode="interleave").df


@query(
    "weighted_sample_mix",
    """WITH c AS (SELECT generator, count(*) AS n FROM jets GROUP BY generator),
        w AS (SELECT * FROM (VALUES ('F', 0.5e0), ('O', 0.3e0), ('P', 0.2e0)) v(generator, w)),
        q AS (SELECT min(n / w) AS room FROM c JOIN w USING (generator))
        SELECT generator, floor(w * room + 1e-9)::BIGINT AS n, floor(w * room + 1e-9)::BIGINT AS distinct_n FROM w, q""",
)
def weighted_sample_mix(spark, d):
    df = jets(spark, d).select("jet_id", "generator")
    parts = [df.where(F.col("generator") == g) for g in "FOP"]
    mix = combine.sample_mix(parts, "jet_id", [0.5, 0.3, 0.2])
    return mix.groupBy("generator").agg(F.count("*").alias("n"), F.countDistinct("jet_id").alias("distinct_n"))


@query("schema_equality", "SELECT true AS same, false AS different, count(*) AS n FROM (" + ACCOUNTS + ")", ())
def schema_equality(spark, d):
    customer, supplier = accounts(spark, d)
    shared = ["id", "balance", "nation"]
    pair = [customer.select(*shared), supplier.select(*reversed(shared))]
    union = combine.concatenate(pair)
    return union.agg(
        F.lit(combine.same_schema(pair)).alias("same"),
        F.lit(combine.same_schema([customer, supplier])).alias("different"),
        F.count("*").alias("n"),
    )
