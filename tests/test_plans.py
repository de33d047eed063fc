"""Plans keep the shape they were written for."""

import pytest
from pyspark.sql import functions as F

from framelake import registry
from framelake.operators import aggregates, frames, labeling
from framelake.plans.detection import detection_report
from framelake.registry.derived import frames as frame_table, image_files
from framelake.plans import medallion

PYTHON_NODES = ("ArrowEvalPython", "MapInArrow", "BatchEvalPython", "FlatMapGroups", "MapInPandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


ROW_LOCAL = [
    "frame_median", "background_subtract", "frame_mean_std", "three_sigma_count", "bronze_features",
    "mad_noise", "dynamic_range", "saturation_fraction", "sigma_mask", "light_stats", "sampled_stats",
    "connected_sources", "source_counts", "source_catalog", "source_lists", "detection_report",
    "file_name_parts", "extract_metadata", "catalog_batch",
]


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_operators_do_not_shuffle(spark, sf, name):
    assert "Exchange" not in plan(registry.QUERIES[name](spark, sf))


NATIVE = [
    "three_sigma_count", "bronze_features", "mad_noise", "sigma_mask", "sampled_stats",
    "long_frame_stats", "silver_triplets", "catalog_batch", "catalog_report", "rolling_pressure",
    "best_worst_by_group", "bucket_distribution", "missing_profile",
]


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_start_no_python(spark, sf, name):
    assert not [n for n in PYTHON_NODES if n in plan(registry.QUERIES[name](spark, sf))]


ONE_SCAN = [
    "bucket_distribution", "missing_profile", "numeric_summary", "catalog_batch", "detection_report",
    "conditional_agg", "silver_triplets", "synthetic_table_profile",
]


@pytest.mark.parametrize("name,scans", [(n, 2 if n == "catalog_batch" else 1) for n in ONE_SCAN])
def test_reports_scan_once(spark, sf, name, scans):
    assert plan(registry.QUERIES[name](spark, sf)).count("FileScan") == scans


def test_triplets_need_two_shuffles(spark, sf):
    # Pixels to statistics by (supplier, flag), statistics to triplets by supplier.
    assert shuffles(registry.QUERIES["silver_triplets"](spark, sf)) == 2


def test_pivot_is_one_shuffle(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    pick = lambda metrics: aggregates.pivot_first(
        orders, "o_custkey", "o_orderstatus", ["F", "O"], metrics, "o_orderkey"
    )
    assert shuffles(pick(["o_totalprice", "o_orderpriority"])) == 1
    numbers = plan(pick(["o_totalprice"]))
    assert shuffles(pick(["o_totalprice"])) == 1 and "SortAggregate" not in numbers and "Sort [" not in numbers


def test_layout_by_key_serves_the_aggregate(spark, sf):
    assert shuffles(registry.QUERIES["partition_layout"](spark, sf)) == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(registry.QUERIES["filter_range"](spark, sf))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "LessThan(l_quantity,20.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in text


def test_top_rows_are_limited_before_the_shuffle(spark, sf):
    for name in ("top_k_per_group", "retain_last_n"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_do_not_copy_staged_arrays(spark, sf):
    bright = frames.frame_stats(frame_table(spark, sf), "pixels").filter(F.col("bright_pixels") > 0)
    assert plan(bright).count("sort_array") == 1
    catalog = labeling.source_catalog(frame_table(spark, sf), ["vec_id"], "pixels", 8, 2.5)
    assert plan(catalog).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("make", [
    lambda f: frames.frame_stats(f, "pixels"),
    lambda f: frames.light_stats(f, "pixels"),
    lambda f: labeling.detect(f, "pixels", 8, 1.5, 2.5, 0.5),
    lambda f: frames.bronze_features(f.withColumn("path", F.lit("a")).withColumn("vec_id", F.col("vec_id")), "path", "pixels"),
    lambda f: detection_report(f.withColumn("path", F.col("vec_id").cast("string")), "path", "pixels", 8),
], ids=["frame_stats", "light_stats", "detect", "bronze_features", "detection_report"])
def test_key_filters_reach_the_scan_and_arrays_are_sorted_once(spark, sf, make):
    out = make(frame_table(spark, sf))
    key = "vec_id" if "vec_id" in out.columns else "file_path"
    text = plan(out.filter(F.col(key) == (5 if key == "vec_id" else "5")))
    if key == "vec_id":
        assert "EqualTo(vec_id,5)" in text.split("PushedFilters")[1][:120]
    stat = next(c for c in ("bright_pixels", "num_objects", "total_objects") if c in out.columns)
    text = plan(out.filter(F.col(stat) > 0))
    sorts = 2 if stat == "total_objects" else 1  # pixels, and for the noise their deviations
    assert text.count("sort_array") == sorts and text.count("ArrowEvalPython") == (stat == "total_objects")


def test_decoding_comes_before_any_shuffle(spark, sf):
    assert "Exchange" not in plan(medallion.bronze(image_files(spark, sf)))


def test_bronze_has_one_python_stage(spark, sf):
    text = plan(medallion.bronze(image_files(spark, sf)))
    assert text.count("MapInArrow") == 2  # encoding the derived files, decoding them


def test_literal_rows_are_broadcast(spark, sf):
    assert "BroadcastHashJoin" in plan(registry.QUERIES["rows_from_memory"](spark, sf))
