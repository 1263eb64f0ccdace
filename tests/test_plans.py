"""Plans are the wanted ones: few exchanges, pruned columns, pushed filters, no Python where none is needed."""

import os
import re

import pytest
from pyspark.sql import functions as F

from seriata.operators import contract, diagnose, joins, order, split
from seriata.plans import inputs
from seriata.plans.queries import QUERIES
from seriata.sources import files

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_aot_takes_one_shuffle_and_four_columns(spark):
    df = QUERIES["aot_by_event_type"](spark, DIR)
    assert exchanges(df) == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(df)).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "ts", "event_type", "value"}


def test_native_queries_stay_in_the_jvm(spark):
    for name in ("certification", "certification_margin", "cat_rho_bar", "cat_conditions", "window_features_native", "join_by_sample_id", "ordered_id_digest", "purge_audit_disjoint", "paired_diff_summary", "signed_rank", "label_law", "moving_block_indices", "numbered_by_ranges", "ks_two_sample"):
        assert not re.search("Python|Arrow|Pandas", plan(QUERIES[name](spark, DIR))), name


def test_agreement_does_not_join_arms(spark):
    df = diagnose.agreement(inputs.arms(spark, DIR), ["g"])
    assert "Join" not in plan(df)


def test_long_vectors_spread_by_position(spark):
    text = plan(diagnose.aot_moments(inputs.series(spark, DIR), ["series_id"], dense=True).hint("merge"))
    joined = re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[series_id#\d+, pos#\d+", text)
    assert joined, text


def test_filters_reach_the_scan(spark, tmp_path):
    values = files.fixture_cell(spark)
    root = str(tmp_path / "bank")
    index = values.where("product = 'val_index_order'")
    files.write_series(values, contract.build_sidecars(index, files.fixture_identity(spark), "dataset_index", commit="c"), root)
    text = plan(files.read_values(spark, root).where("cell_id = 'cell' and product = 'val_perm' and pos < 3"))
    assert re.search(r"PartitionFilters: \[[^\]]*cell_id[^\]]*product", text) and re.search(r"PushedFilters: \[[^\]]*LessThan\(pos,3\)", text)


def test_id_join_moves_ids_and_values_only(spark):
    a = spark.range(10).select(F.concat(F.lit("w"), "id").alias("sample_id"), F.col("id").alias("pos"), F.rand(1).alias("value"), F.lit("x" * 50).alias("unused"))
    assert "unused" not in plan(joins.join_by_sample_id({"a": a, "b": a}, check=False))


def test_split_and_stride_need_no_shuffle(spark):
    rows = spark.range(100).select(F.col("id").alias("window_origin"), F.col("id").alias("pos"))
    assert exchanges(split.purged_split(rows, F.lit(100), F.lit(5))) == 0
    assert exchanges(order.strided(rows, [1, 4])) == 0
