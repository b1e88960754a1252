"""A third of all orders belong to one customer and slice, a third share one price, a third of all items one order."""

import duckdb
import oracle
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = """flat_spectrum_histogram min_count_resampling contiguous_split balanced_classes weighted_sample_mix exact_auc
roc_points rejection_at_bin_efficiency all_metrics_per_slice efficiency_grid flatten_with_cuts features_const
pair_matrix_int_const pair_matrix_int_rel_const features_const_topo nearest_neighbours neighbours_of_all_hits long_to_segments
neighbour_information_ranking binned_metrics_by_generator metrics_from_ingested_chunks shuffled_reading physical_weight fixed_size_batches
load_parallel_take_per_file working_point_per_bin""".split()


@pytest.fixture(scope="module")
def skewed(data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in oracle.TABLES:
        rows = f"SELECT * FROM '{data}/{name}.parquet'"
        if name == "orders":
            rows = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey, o_orderstatus,
                CASE WHEN o_orderkey % 3 = 1 THEN 123456.78 ELSE o_totalprice END AS o_totalprice, o_orderdate,
                CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM ({rows})"""
        if name == "lineitem":
            rows = f"""SELECT CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey,
                * EXCLUDE (l_orderkey) FROM ({rows})"""
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_skewed_query(spark, skewed, name):
    assert oracle.compare(QUERIES[name](spark, skewed), oracle.connect(skewed), ORACLES[name]) is None
