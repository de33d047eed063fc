"""Path rules, source specifications, sinks."""

import gzip

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake import schemas
from framelake.functions import naming
from framelake.operators import aggregates, history, relational
from framelake.plans import catalog
from framelake.registry import derived
from framelake.sources import images, sinks, specs, tables


def of_path(spark, path, **columns):
    df = spark.createDataFrame([(path,)], "path string")
    return df.select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def rules():
    return dict(
        object_id=naming.object_id("path"), image_type=naming.image_type("path"),
        telescope=naming.telescope_id("path"), time=naming.observation_time("path"),
        moment=naming.observation_timestamp("path"), field=naming.field_id("path"),
        ccd=naming.ccd_id("path"), band=naming.filter_band(naming.ccd_id("path")),
        date=naming.observation_date("path"), exposure=naming.exposure_id("path"),
        kind=naming.classify_by_patterns("path", specs.ZTF_PATTERNS),
    )


def test_path_with_digits(spark):
    assert of_path(spark, "/raw/2025030412_science.fits", **rules()) == dict(
        object_id="2025030412", image_type="SCIENCE", telescope="2025", time="2025-25-03T04:12:00",
        moment=None, field=202, ccd=50, band="i", date="2020-25-03", exposure=2025030412, kind="SCIENCE",
    )


def test_path_without_digits(spark):
    assert of_path(spark, "/raw/plain.fits", **rules()) == dict(
        object_id="plain", image_type="UNKNOWN", telescope="UNKNOWN", time="UNKNOWN", moment=None,
        field=None, ccd=None, band=None, date=None, exposure=None, kind="UNKNOWN",
    )


@pytest.mark.parametrize("path,kind", [
    ("/science/difference_x.fits", "DIFFERENCE"), ("/a/template_science.fits", "SCIENCE"),
    ("/a/TEMPLATE.fits", "UNKNOWN"), ("/a/b_template.fits", "TEMPLATE"),
])
def test_type_words(spark, path, kind):
    assert of_path(spark, path, k=naming.type_from_substring("path"))["k"] == kind


def test_detector_zero_has_no_band(spark):
    assert of_path(spark, "/raw/123001.fits", b=naming.filter_band(naming.ccd_id("path")),
                   c=naming.ccd_id("path")) == {"b": None, "c": 0}


def test_new_source_without_subclassing(spark):
    spec = specs.SourceSpec("LAB").with_pattern("RAW", r"\.raw$").with_pattern("ANY", ".")
    spec = spec.with_extractor("run", lambda p: naming.digit_run(p, 3))
    rows = spark.createDataFrame([("/d/a123.raw",), ("/d/b.txt",), ("/d/",)], "path string")
    out = [tuple(r) for r in specs.extract_metadata(rows, "path", spec).collect()]
    assert out == [("/d/a123.raw", "LAB", "RAW", "123"), ("/d/b.txt", "LAB", "ANY", None),
                   ("/d/", "LAB", "UNKNOWN", None)]


def test_catalog_of_nothing(spark):
    empty = catalog.catalog([], "t", spark=spark)
    assert empty.schema == schemas.CATALOG and empty.count() == 0
    report = catalog.quality_report(empty, "t").first()
    assert report["total_files"] == 0
    assert report["quality_metrics"]["missing_field_id"]["missing_percentage"] == 0


def test_listing_reads_no_content_and_skips_bad_paths(spark, tmp_path):
    (tmp_path / "a_science.fits").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"y")
    listing, skipped = tables.scan_listings(
        spark, [f"{tmp_path}/*.fits", f"{tmp_path}/none/*", "nofs://x/y"]
    )
    assert skipped == [f"{tmp_path}/none/*", "nofs://x/y"]
    assert [r["length"] for r in listing.collect()] == [10]
    assert "content:binary" not in listing._jdf.queryExecution().executedPlan().toString()
    rows = specs.source_catalog_rows(listing, specs.ZTF, "now").first()
    assert (rows["telescope"], rows["data_type"]) == ("ZTF", "SCIENCE")


def test_text_lines(spark, tmp_path):
    df = spark.createDataFrame([("p", None, 1.5), (None, 2, 0.25)], "a string, b int, c double")
    path = sinks.sink_text_rows(df, f"{tmp_path}/t", formats={"c": "%.4f"})
    assert sorted(r[0] for r in tables.scan_text(spark, path).collect()) == ["None,2,0.2500", "p,None,1.5000"]


def test_publish_replaces_and_cleans_up(spark, tmp_path):
    target = f"{tmp_path}/run"
    sinks.sink_publish_run(spark.range(5), target)
    sinks.sink_publish_run(spark.range(3), target)
    assert spark.read.parquet(target).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["run"]


def test_failed_publish_keeps_the_old_run(spark, tmp_path):
    target = f"{tmp_path}/run"
    sinks.sink_publish_run(spark.range(5), target)
    with pytest.raises(Exception):
        sinks.sink_publish_run(spark.range(3).select(F.raise_error(F.lit("no"))), target)
    assert spark.read.parquet(target).count() == 5


def test_buckets_ignore_nan_and_one(spark):
    scores = [0.0, 0.4, 0.6, 0.8, 1.0, float("nan"), None]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    out = {r["bucket"]: r["n"] for r in aggregates.bucket_distribution(df, "score").collect()}
    assert out == {"Poor": 1, "Fair": 1, "Good": 1, "Excellent": 1}
    none = aggregates.bucket_distribution(df.limit(0), "score").collect()
    assert [(r["n"], r["percent"]) for r in none] == [(0, 0.0)] * 4


def test_rate_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "v double")
    row = aggregates.numeric_summary(empty, "v").first()
    assert (row["n"], row["total"], row["mean"]) == (0, None, 0.0)
    assert aggregates.success_rate(empty, F.col("v") > 0).first()["success_rate"] == 0.0


def test_conform_casts_and_fills(spark):
    df = spark.createDataFrame([(3.7, "x")], "exposure_id double, extra string")
    row = relational.conform_to_schema(df, schemas.CATALOG)
    assert row.schema == schemas.CATALOG and row.first()["exposure_id"] == 3


def test_estimates(spark):
    jobs = spark.createDataFrame(
        [(1, 10, 0.0), (2, 10, 5.0), (3, 20, 10.0), (4, 8, 1.0)], "t int, files int, seconds double"
    ).withColumn("host", F.lit("h"))
    out = history.rolling_throughput(jobs, ["host"], ["t"], "files", "seconds", F.lit(0.5))
    got = {r["t"]: r["estimated_seconds"] for r in out.collect()}
    # No history, then only a job of no time, then a rate of 2 files per second at 1.25 load.
    assert got == {1: 20.0, 2: 20.0, 3: 12.5, 4: 5.0}


def test_efficiency_needs_two_sizes(spark):
    one = spark.createDataFrame([(100, 5.0)], "n int, thr double")
    row = history.scaling_verdict(history.scaling_efficiency(one, "n", "thr")).first()
    assert (row["avg_efficiency"], row["verdict"]) == (None, None)


def test_shared_folder(spark):
    from types import SimpleNamespace

    from framelake import workspace

    assert workspace.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    unset = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(RuntimeError):
        workspace.shared_root(cluster)
    local = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[2]", applicationId="b"))
    assert workspace.shared_root(local) == workspace.shared_root(local)


def test_all_members_of_a_gzip_stream(spark):
    data = gzip.compress(b"abc") + gzip.compress(b"def")
    df = spark.createDataFrame([(1, data), (2, b"x"), (3, None), (4, b""), (5, data[:20])], "k int, content binary")
    found = {r["k"]: r["content"] for r in images.inflate_stamps(df).collect()}
    assert found == {1: b"abcdef", 2: None, 3: None, 4: None, 5: None}


def test_fallback_ids_follow_the_content(spark):
    stamp = "struct<stampData:binary>"
    schema = f"candid long, alertId long, cutoutScience {stamp}, cutoutTemplate {stamp}, cutoutDifference {stamp}"
    rows = [(0, None, (bytes([i]),), None, None) for i in range(9)]
    ids = lambda n: sorted(r["candid"] for r in images.explode_cutouts(spark.createDataFrame(rows, schema).repartition(n)).collect())
    assert ids(1) == ids(4) and len(set(ids(1))) == 9 and max(ids(1)) < 0


def test_image_file_names(spark, tmp_path):
    rows = [("x:y%.fits", b"one"), ("a+b c.fits", b"two")]
    df = spark.createDataFrame(rows, "file_name string, content binary")
    path = sinks.sink_image_files(df, f"{tmp_path}/named")
    back = sinks.named_image_files(tables.scan_binary(spark, path, recursive=True)).collect()
    assert {r["path"].rsplit("/", 1)[1]: bytes(r["content"]).strip() for r in back} == dict(rows)
    with pytest.raises(ValueError):
        sinks.sink_image_files(df.union(df), f"{tmp_path}/twice")


def test_a_failed_publish_keeps_the_old_run(spark, tmp_path):
    target = f"{tmp_path}/run"
    sinks.sink_publish_run(spark.range(3), target)

    def broken(df, path):
        raise OSError("disk")

    with pytest.raises(OSError):
        sinks.sink_publish_run(spark.range(5), target, broken)
    assert spark.read.parquet(target).count() == 3
    # A crash between the renames: the old run lies aside and comes back with the next call.
    (tmp_path / "run").rename(tmp_path / "run.__old__")
    with pytest.raises(OSError):
        sinks.sink_publish_run(spark.range(5), target, broken)
    assert spark.read.parquet(target).count() == 3
    sinks.sink_publish_run(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and not (tmp_path / "run.__old__").exists()


def test_a_partition_function_is_called_once_per_partition(spark):
    def tally(pairs):
        yield "n", sum(1 for _ in pairs)

    files = spark.range(50).selectExpr("cast(id as string) as path", "cast('x' as binary) as content").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = images.map_files(files, tally, schemas.struct(path=schemas.STRING, n=schemas.INT)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 2 and sum(r["n"] for r in rows) == 50


def test_shared_folder_rules(spark):
    from types import SimpleNamespace

    from framelake import workspace

    assert workspace.new_folder(spark, "x").startswith(workspace.run_folder(spark))

    def session(master, root=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: root or default),
            sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
        )

    assert workspace.shared_root(session("spark://x:7077", "hdfs://store/tmp/")) == "hdfs://store/tmp"
    for master in ("local-cluster[2,1,1024]", "spark://x:7077", "yarn"):
        with pytest.raises(RuntimeError):
            workspace.shared_root(session(master))


def test_image_files_share_folders(spark, tmp_path):
    """Folders come with a thousand files, not with each, so listing them stays short."""
    rows = spark.range(2_500).selectExpr("concat(id, '/science#.fits') AS file_name", "cast(cast(id AS string) AS binary) AS content")
    path = sinks.sink_image_files(rows, f"{tmp_path}/many")
    assert 1 <= sum(p.is_dir() for p in (tmp_path / "many").rglob("*")) <= 4
    assert sum(p.is_file() for p in (tmp_path / "many").rglob("name=*")) == 2_500
    back = sinks.named_image_files(tables.scan_binary(spark, path, recursive=True)).collect()
    names = {r["path"].split("/many/")[1]: bytes(r["content"]) for r in back}
    assert names == {f"{i}/science#.fits": f"{i}\n".encode() for i in range(2_500)}
    # Written again: the files before are gone. Missing names and bytes are files too.
    few = spark.createDataFrame([(None, b"x"), ("empty", None)], "file_name string, content binary")
    again = sinks.named_image_files(tables.scan_binary(spark, sinks.sink_image_files(few, path), recursive=True)).collect()
    assert {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in again} == {sinks.NO_NAME: b"x\n", "empty": b"\n"}
    assert tables.scan_binary(spark, sinks.sink_image_files(few.limit(0), path), recursive=True).count() == 0


def test_image_files_are_all_there_or_none(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"x"), ("b" * 300, b"y")], "file_name string, content binary")
    with pytest.raises(Exception):
        sinks.sink_image_files(rows, f"{tmp_path}/broken")  # no file system holds the second name
    assert not (tmp_path / "broken").exists()


def test_paths_of_other_files_stay(spark):
    paths = ["file:/a/000001/name=x%2Fy.fits", "file:/a/name=x+y%25.fits/part-0.txt", "file:/a/missing", "/b/c.fits"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in sinks.named_image_files(df).collect()] == ["file:/a/x/y.fits", "file:/a/x+y%.fits", "file:/a/missing", "/b/c.fits"]


def test_frames_become_files_in_small_batches():
    """A batch of frames is twenty times as large as files, which a worker does not hold at once."""
    n = 10_000
    frames = pa.RecordBatch.from_pydict({
        "vec_id": pa.array(range(n), pa.int64()), "pixels": pa.array([[float(i)] * 64 for i in range(n)], pa.list_(pa.float32())),
        "path": [f"{i}.fits" for i in range(n)]})
    batches = list(derived.encoded(False)(iter([frames, frames.slice(0, 0)])))
    assert max(b.num_rows for b in batches) <= derived.FILES_PER_BATCH
    assert [i for b in batches for i in b.column("vec_id").to_pylist()] == list(range(n))
    assert {len(f) for b in batches for f in b.column("content").to_pylist()} == {5760}
