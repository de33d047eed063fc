"""Image statistics, sources and decoding on hand-checked and random images."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import schemas
from framelake.operators import frames as fr, labeling as lab
from framelake.plans import detection, medallion
from framelake.sources import images as im
from tests.helpers import brute_components, fits_bytes, frames_of, golden_image

TOLERANCE = 1e-5


def near(value):
    return pytest.approx(value, rel=TOLERANCE)


def test_golden_bronze(spark):
    df = frames_of(spark, {"/raw/1_science.fits": golden_image()})
    row = fr.bronze_features(df, "frame_id", "pixels", "status").first()
    assert (row["object_id"], row["image_type"], row["status"]) == ("1", "SCIENCE", "SUCCESS")
    assert row["median_bg"] == near(10.0)
    assert row["mean_sub"] == near(11.634921)
    assert row["std_sub"] == near(43.571255)
    assert row["bright_pixels"] == 3


def test_golden_detection(spark):
    df = frames_of(spark, {"/raw/2025030412_science.fits": golden_image()})
    row = detection.detection_report(df, "frame_id", "pixels", "width", "status").first()
    assert row["background_level"] == near(10.0) and row["background_noise"] == near(1.4826)
    assert row["dynamic_range"] == near(191.0) and row["saturation_fraction"] == 0.0
    assert (row["total_objects"], row["bright_sources"], row["faint_sources"]) == (2, 1, 1)
    position, = row["source_positions"]
    assert (position["x"], position["y"]) == (near(6.0), near(2.75))
    source, = row["photometry_data"]
    assert source["flux_total"] == near(710.0) and source["flux_peak"] == near(190.0)
    assert source["area_pixels"] == 4
    assert source["magnitude_estimate"] == near(17.871854) and source["snr"] == near(128.153244)
    assert row["quality_score"] == near(0.505796)
    assert (row["telescope_id"], row["observation_time"]) == ("2025", "2025-25-03T04:12:00")
    assert row["processing_status"] == "SUCCESS"


def test_edge_images(spark):
    images = {
        "nan": np.full((2, 2), np.nan, np.float32), "none": None,
        "constant": np.full((3, 3), 0.1, np.float32), "one": np.array([[5.0]], np.float32),
        "inf": np.array([[1, 2, np.inf], [3, -np.inf, np.nan]], np.float32),
    }
    df = frames_of(spark, images)
    bronze = {r["file_path"]: r for r in fr.bronze_features(df, "frame_id", "pixels").collect()}
    assert bronze["nan"]["status"] == "ERR:AllNaN" and bronze["nan"]["median_bg"] is None
    assert bronze["none"]["status"] == "ERR:NoImageData" and bronze["none"]["bright_pixels"] is None
    assert bronze["constant"]["std_sub"] == 0 and bronze["constant"]["bright_pixels"] == 0
    assert (bronze["one"]["median_bg"], bronze["one"]["mean_sub"]) == (5.0, 0.0)
    assert bronze["inf"]["median_bg"] == 2.0
    rows = {r["file_path"]: r
            for r in detection.detection_report(df, "frame_id", "pixels", "width", "status").collect()}
    assert len(rows) == len(images)
    assert rows["nan"]["processing_status"] == "ALL_NAN" and rows["nan"]["quality_score"] == 0
    assert rows["none"]["processing_status"] == "NO_IMAGE_DATA"
    # No noise and no range: saturation and source count are the only factors.
    assert rows["constant"]["quality_score"] == 0.5 and rows["constant"]["total_objects"] == 0
    light = {r["frame_id"]: r for r in fr.light_stats(df, "pixels").collect()}
    assert (light["nan"]["mean_value"], light["nan"]["num_objects"]) == (0.0, 0)
    lines = {r["path"]: r for r in
             fr.frame_stats_lines(fr.bronze_features(df, "frame_id", "pixels")).collect()}
    assert lines["nan"]["bright_or_error"] == "ERR:AllNaN" and lines["one"]["bright_or_error"] == "0"


@pytest.fixture(scope="module")
def sky(spark):
    rng = np.random.default_rng(11)
    images = {}
    for n in range(12):
        image = rng.normal(100, 3, (20 + n, 17)).astype(np.float32)
        image[rng.random(image.shape) < 0.12] += rng.choice([20, 60])
        image[0, 0] = np.nan
        images[f"f{n:02d}"] = image
    return images


def expected(image):
    good = image[np.isfinite(image)].astype(np.float64)
    level = np.median(good)
    noise = 1.4826 * np.median(np.abs(good - level))
    above = np.where(np.isfinite(image), image.astype(np.float64) - level, -np.inf)
    return level, noise, above


def test_statistics_and_sources_match_numpy(spark, sky):
    rows = lab.detect(frames_of(spark, sky).drop("status"), "pixels", "width").collect()
    for row in rows:
        level, noise, above = expected(sky[row["frame_id"]])
        assert row["background_level"] == near(level) and row["background_noise"] == near(noise)
        bright = brute_components(above > 10 * noise)
        assert row["total_objects"] == len(brute_components(above > 5 * noise))
        assert row["bright_sources"] == len(bright)
        for source, region in zip(row["sources"], bright):
            flux = np.array([above[p] for p in region])
            assert source["flux_total"] == near(flux.sum()) and source["flux_peak"] == near(flux.max())
            assert source["y"] == near(np.mean([p[0] for p in region]))
            assert source["x"] == near(np.mean([p[1] for p in region]))
        assert [s["label"] for s in row["sources"]] == list(range(1, len(bright) + 1))


def test_row_plan_equals_pixel_plan(spark, sky):
    df = frames_of(spark, sky)
    by_row = lab.source_catalog(df, ["frame_id"], "pixels", "width", 5.0)
    mask = fr.sigma_mask(df, ["frame_id"], "pixels", F.col("width"), 5.0)
    by_pixel = lab.number_sources(
        lab.measure_sources(lab.label_pixels(mask, ["frame_id"], 8), ["frame_id"], "above"),
        ["frame_id"],
    )
    key = lambda r: (r["frame_id"], r["label"])
    for a, b in zip(sorted(by_row.collect(), key=key), sorted(by_pixel.collect(), key=key), strict=True):
        assert key(a) == key(b)
        assert (a["x"], a["y"], a["area_pixels"]) == (near(b["x"]), near(b["y"]), b["area_pixels"])
        assert a["flux_total"] == near(b["flux_total"])


def test_invariants(spark, sky):
    base = frames_of(spark, sky).select("frame_id", "width", "pixels")
    stats = lambda df: {r["frame_id"]: r for r in fr.frame_stats(df, "pixels").collect()}
    shifted = base.withColumn("pixels", F.transform("pixels", lambda v: v + 1000.0))
    scaled = base.withColumn("pixels", F.transform("pixels", lambda v: v * 4.0))
    plain, moved, larger = stats(base), stats(shifted), stats(scaled)
    for name, row in plain.items():
        assert moved[name]["std_sub"] == pytest.approx(row["std_sub"], rel=1e-4)
        assert moved[name]["bright_pixels"] == row["bright_pixels"] == larger[name]["bright_pixels"]
    turned = frames_of(spark, {k: v.T.copy() for k, v in sky.items()})
    count = lambda df: {r["frame_id"]: r["n_sources"]
                        for r in lab.connected_sources(df, "pixels", "width").collect()}
    assert count(frames_of(spark, sky)) == count(turned)


def test_sampling(spark, sky):
    df = frames_of(spark, sky).select("frame_id", "pixels")
    draw = lambda seed, n: sorted(
        map(tuple, fr.sampled_stats(df, "pixels", ["frame_id"], n, seed).collect())
    )
    assert draw(1, 50) == draw(1, 50) != draw(2, 50)
    assert draw(1, 10_000) == sorted(map(tuple, fr.light_stats(df, "pixels").collect()))


def test_sample_is_the_smallest_hashes(spark, sky):
    """The bounded draw equals a full sort by hash, also when the bound lets too few through."""
    df = frames_of(spark, sky).select("frame_id", "pixels")
    for n in (1, 7, 60, 300):
        drawn = df.select("frame_id", fr._sampled_pixels("pixels", ["frame_id"], n, 3).alias("s"))
        got = {r["frame_id"]: sorted(map(str, r["s"])) for r in drawn.collect()}
        tagged = df.select("frame_id", F.posexplode("pixels")).withColumn(
            "h", F.pmod(F.xxhash64("frame_id", "pos", F.lit(3)), F.lit(1 << 40))
        )
        by_frame = {}
        for r in tagged.collect():
            by_frame.setdefault(r["frame_id"], []).append((r["h"], r["pos"], r["col"]))
        want = {k: sorted(str(v) for _, _, v in sorted(rows, key=lambda t: t[:2])[:n])
                for k, rows in by_frame.items()}
        assert got == want


def files_of(spark, contents):
    return spark.createDataFrame(
        [(name, bytearray(data)) for name, data in contents.items()], "path string, content binary"
    )


def test_decoding(spark):
    plain = np.arange(6, dtype=np.float32).reshape(2, 3)
    contents = {
        "f4": fits_bytes(plain), "f8": fits_bytes(plain, -64), "u1": fits_bytes(plain, 8),
        "i4": fits_bytes(plain, 32), "i8": fits_bytes(plain, 64),
        "scaled": fits_bytes(plain, 16, {"BSCALE": "2.0", "BZERO": "10"}),
        "blank": fits_bytes(plain, 16, {"BLANK": "3"}),
        "second": fits_bytes(plain, -32, empty_first=True),
        "gz": gzip.compress(fits_bytes(plain)),
        "cut": fits_bytes(plain)[:2890], "empty": b"", "text": b"hello",
        "header only": fits_bytes(plain, -32, empty_first=True)[:2880],
        "nan": fits_bytes(np.full((2, 2), np.nan)), "cube": fits_bytes(np.zeros((2, 3, 4))),
    }
    rows = {r["frame_id"]: r for r in im.decode_frames(files_of(spark, contents)).collect()}
    assert len(rows) == len(contents)
    for name in ("f4", "f8", "u1", "i4", "i8", "second", "gz"):
        row = rows[name]
        assert (row["height"], row["width"], row["status"]) == (2, 3, "SUCCESS"), name
        assert row["pixels"] == list(range(6))
    assert rows["scaled"]["pixels"] == [10 + 2 * v for v in range(6)]
    assert np.isnan(rows["blank"]["pixels"][3])
    assert rows["cut"]["status"] == "ERR:truncated data"
    assert rows["empty"]["status"].startswith("ERR:") and rows["text"]["status"] == "ERR:not an image file"
    assert rows["header only"]["status"] == "ERR:NoImageData"
    assert rows["nan"]["status"] == "ERR:AllNaN"
    assert (rows["cube"]["height"], rows["cube"]["width"]) == (6, 4)


def test_bronze_from_files(spark):
    contents = {
        "/raw/7_science.fits": fits_bytes(golden_image()), "/raw/7_template.fits": b"junk",
        "/raw/plain.fits": fits_bytes(golden_image()),
    }
    bronze = medallion.bronze(files_of(spark, contents))
    assert bronze.schema.simpleString() == schemas.BRONZE.simpleString()
    rows = {r["file_path"]: r for r in bronze.collect()}
    good, bad = rows["/raw/7_science.fits"], rows["/raw/7_template.fits"]
    assert good["bright_pixels"] == 3 and good["std_sub"] == near(43.571255)
    assert (bad["object_id"], bad["image_type"], bad["median_bg"]) == ("7", "UNKNOWN", None)
    assert bad["status"].startswith("ERR:")
    assert rows["/raw/plain.fits"]["image_type"] == "UNKNOWN"
    found = {r["file_path"]: r for r in detection.detections(files_of(spark, contents)).collect()}
    assert found["/raw/7_template.fits"]["processing_status"].startswith("ERROR_")
    assert found["/raw/7_template.fits"]["total_objects"] == 0


def test_cutouts(spark):
    stamp = gzip.compress(fits_bytes(golden_image()))
    rows = [
        (5, 50, (stamp,), (stamp,), (stamp,)), (None, 60, (stamp,), None, (b"",)),
        (0, 70, (None,), (stamp,), None), (None, None, (stamp,), None, None),
    ]
    cutouts = im.explode_cutouts(spark.createDataFrame(rows, schemas.ALERTS))
    names = sorted(r["file_name"] for r in cutouts.collect())
    assert len(names) == 6 and set(names) >= {
        "5_difference.fits", "5_science.fits", "5_template.fits", "60_science.fits", "70_template.fits"
    }
    raw = im.inflate_stamps(cutouts).select(F.octet_length("content")).distinct().collect()
    assert [r[0] for r in raw] == [5760]


def test_summary_of_detections(spark):
    rows = [("SCIENCE", "SUCCESS", 4, 1, 0.85), ("SCIENCE", "SUCCESS", 2, 1, float("nan")),
            ("TEMPLATE", "ALL_NAN", 0, 0, 0.0), ("SCIENCE", "SUCCESS", 0, 0, 1.0)]
    df = spark.createDataFrame(
        rows, "image_type string, processing_status string, total_objects int, bright_sources int, quality_score double"
    )
    out = detection.detection_summary(df, "t").first()
    assert (out["total_files"], out["successful_files"], out["success_rate"]) == (4, 3, 0.75)
    assert out["quality_distribution"] == {"Excellent": 1, "Good": 0, "Fair": 0, "Poor": 1}
    stats, = out["detection_stats"]
    assert (stats["image_type"], stats["num_images"], stats["avg_objects"]) == ("SCIENCE", 3, 2.0)
    empty = detection.detection_summary(df.limit(0), "t").first()
    assert (empty["total_files"], empty["success_rate"]) == (0, 0.0)
