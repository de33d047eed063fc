"""Streams give what batches give; clustering repeats and is consistent."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from framelake import schemas
from framelake.operators import clustering as ml
from framelake.plans import medallion
from framelake.sources import tables
from framelake.streaming import live
from tests.helpers import fits_bytes, golden_image


def test_running_stats_over_two_drops(spark, tmp_path):
    folder = f"{tmp_path}/gold"
    rows = spark.range(100).selectExpr("cast(id as int) objects", "id / 100 as quality")
    rows.filter("objects < 60").write.parquet(folder)
    rows.filter("objects >= 60").write.mode("append").parquet(folder)
    stream = live.stream_parquet(spark, folder, rows.schema, files_per_batch=1)
    row = live.live_gold_stats(stream, "objects", "quality").first()
    assert tuple(row) == (100, 49.5, 0.99)


def test_gold_pending_then_ready(spark, tmp_path):
    (tmp_path / "bronze").mkdir()
    (tmp_path / "bronze" / "part-0").write_text("a\nb\n")
    schema = schemas.struct(objects=schemas.INT, quality=schemas.DOUBLE)
    gold = lambda: live.stream_parquet(spark, f"{tmp_path}/run_*", schema)
    watch = lambda: live.live_pending_gold(
        live.stream_text(spark, f"{tmp_path}/bronze"), gold(), "objects", "quality"
    ).first()
    assert tuple(watch()) == (2, None, None, None, "pending")
    spark.createDataFrame([(3, 0.5)], schema).write.parquet(f"{tmp_path}/run_1")
    assert tuple(watch()) == (2, 1, 3.0, 0.5, "ready")


def test_a_monitor_restarts_and_stays_live(spark, tmp_path):
    folder, state = f"{tmp_path}/gold", f"{tmp_path}/state"
    rows = spark.range(100).selectExpr("cast(id as int) objects", "id / 100 as quality")
    rows.filter("objects < 60").write.parquet(folder)
    watch = lambda **options: live.live_gold_stats(
        live.stream_parquet(spark, folder, rows.schema), "objects", "quality", checkpoint=state, **options
    )
    assert watch().first()["gold_rows"] == 60
    assert watch().first()["gold_rows"] == 60  # nothing new
    rows.filter("objects >= 60").write.mode("append").parquet(folder)
    assert watch().first()["gold_rows"] == 100
    query = live.live_bronze_count(
        live.stream_parquet(spark, folder, rows.schema), trigger={"processingTime": "1 second"}
    )
    try:
        query.processAllAvailable()
        assert query.isActive and spark.table(query.name).first()[0] == 100
    finally:
        query.stop()


def test_images_are_ingested_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    ingest = lambda: live.live_bronze_ingest(
        live.stream_images(spark, str(raw)), f"{tmp_path}/bronze", f"{tmp_path}/checkpoint"
    )
    (raw / "1_science.fits").write_bytes(fits_bytes(golden_image()))
    assert ingest().count() == 1
    (raw / "2_science.fits").write_bytes(b"broken")
    (raw / "3_template.fits").write_bytes(fits_bytes(golden_image()))
    live_rows = ingest()
    batch = medallion.bronze(tables.scan_binary(spark, str(raw)))
    key = lambda df: sorted(map(str, df.drop("file_path").collect()))
    assert key(live_rows) == key(batch) and live_rows.count() == 3


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    centers = np.array([[0, 0, 0], [40, 5, 0], [0, 9, 70]])
    rows = [(str(i), *map(float, centers[i % 3] + rng.normal(0, 1, 3))) for i in range(300)]
    return spark.createDataFrame(rows, "object_id string, a double, b double, c double")


def test_clusters(spark, points):
    vectors = ml.standardize(ml.assemble_features(points, ["a", "b", "c"]))
    rows, model = ml.kmeans_fit_assign(vectors, "object_id")
    again, _ = ml.kmeans_fit_assign(vectors.repartition(5), "object_id")
    assert sorted(r["n"] for r in ml.cluster_sizes(rows).collect()) == [100, 100, 100]
    pick = lambda df: sorted(map(tuple, df.select("object_id", "cluster").collect()))
    assert pick(rows) == pick(again)
    centers = np.array(model.clusterCenters())
    for row in rows.select(vector_to_array("features").alias("f"), "cluster").collect():
        assert np.argmin(((centers - np.array(row["f"])) ** 2).sum(axis=1)) == row["cluster"]
    assert ml.silhouette(rows) > 0.9
    named = ml.cluster_names(rows, model).groupBy("cluster_name", "cluster").count()
    assert {r["cluster_name"] for r in named.collect()} == set(ml.CLUSTER_NAMES)


def test_scaling_uses_the_sample_deviation(spark, points):
    scaled = ml.standardize(ml.assemble_features(points, ["a", "b", "c"]))
    values = np.array([r[0] for r in scaled.select(vector_to_array("features")).collect()])
    assert values.mean(axis=0) == pytest.approx([0, 0, 0], abs=1e-9)
    assert values.std(axis=0, ddof=1) == pytest.approx([1, 1, 1])


def test_missing_feature_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception):
        ml.assemble_features(df, ["a", "b"]).collect()
