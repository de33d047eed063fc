"""Listings made by tasks, files read in packs, and images read in bands."""

from pyspark.sql import functions as F

from framelake.operators.frames import frame_stats, pixel_explode
from framelake.registry.base import query, rounded, sql_round as r
from framelake.registry.derived import FRAME_PATH, FRAME_STATS_SQL, PIXELS_SQL, SIDE, frames, noise_sql
from framelake.operators.selection import exact_medians, background_noise_long, sampled_stats_long
from framelake.plans.large_images import large_detections
from framelake.registry.images import (
    BRIGHT, DETECT, DETECTION_SQL, REPORT_NUMBERS, SAMPLE, SAMPLED_STATS_SQL, SATURATED, SEED, md5_hash,
)
from framelake.registry.sources_sinks import written_images
from framelake.sources.bands import band_pixels, read_bands
from framelake.sources.images import decode_frames
from framelake.sources.manifest import list_files, read_files
from framelake.sources.sinks import named_image_files

FILE_NAME_SQL = f"regexp_extract({FRAME_PATH}, '[^/]*$')"


def manifest(spark, sf):
    """The frames' files and a folder that is not there."""
    folder = written_images(spark, sf)
    return list_files(spark, [folder, f"{folder}/missing"])


@query("scan_manifest", f"""
SELECT {FILE_NAME_SQL} AS file_name, CAST(5761 AS BIGINT) AS length, 'SUCCESS' AS status FROM embeddings
UNION ALL SELECT 'missing', NULL, 'ERR'""")
def scan_manifest(spark, sf):
    return named_image_files(manifest(spark, sf)).select(
        F.substring_index("path", "/", -1).alias("file_name"), "length", F.substring_index("status", ":", 1).alias("status")
    )


@query("scan_packed", f"""
SELECT file_name, {r("median_bg")} AS median_bg, bright_pixels
FROM (SELECT vec_id, {FILE_NAME_SQL} AS file_name FROM embeddings) JOIN {FRAME_STATS_SQL} USING (vec_id)
UNION ALL SELECT 'missing', NULL, NULL""")
def scan_packed(spark, sf):
    """Files in packs of about a hundred; the missing folder stays a row without statistics."""
    files = read_files(manifest(spark, sf), bytes_per_task=1_000_000, open_cost=4_000)
    stats = frame_stats(decode_frames(named_image_files(files)).drop("height", "width", "status"), "pixels")
    out = stats.select(F.substring_index("frame_id", "/", -1).alias("file_name"), "median_bg", "bright_pixels")
    return rounded(out, "median_bg")


@query("image_bands", f"""
SELECT {FILE_NAME_SQL} AS file_name, y, x, v FROM embeddings JOIN {PIXELS_SQL} USING (vec_id)""")
def image_bands(spark, sf):
    """Pixel rows of the frames' files, three lines a band."""
    files = list_files(spark, written_images(spark, sf))
    bands = read_bands(files, band_bytes=3 * 8 * 4)
    named = named_image_files(band_pixels(bands).withColumnRenamed("frame_id", "path"))
    return named.select(F.substring_index("path", "/", -1).alias("file_name"), "y", "x", "v")


def pixels(spark, sf):
    return pixel_explode(frames(spark, sf), ["vec_id"], "pixels", SIDE)


@query("selected_medians", f"""
SELECT CAST(y AS INTEGER) AS y, count(*) AS n_valid, {r("median(v)")} AS median FROM {PIXELS_SQL} GROUP BY y""")
def selected_medians(spark, sf):
    """One median per image line over all frames: a few groups that each hold an eighth of the pixels."""
    return rounded(exact_medians(pixels(spark, sf), ["y"], "v"), "median")


@query("selected_noise", f"""
SELECT vec_id, CAST({SIDE * SIDE} AS BIGINT) AS n_valid, {r("background_level")} AS background_level,
       {r("background_noise")} AS background_noise FROM {noise_sql()}""")
def selected_noise(spark, sf):
    return rounded(background_noise_long(pixels(spark, sf), ["vec_id"], "v"), "background_level", "background_noise")


@query("sampled_stats_long", SAMPLED_STATS_SQL)
def sampled_stats_of_pixels(spark, sf):
    """The draw of ``sampled_stats`` from pixel rows dealt over many tasks."""
    rows = pixels(spark, sf).withColumn("place", F.col("y") * SIDE + F.col("x")).repartition(13)
    out = sampled_stats_long(rows, ["vec_id"], "place", "v", SAMPLE, SEED, md5_hash)
    return rounded(out, "mean_value", "std_value")


@query("large_detections", DETECTION_SQL)
def large_detection_rows(spark, sf):
    """Detection rows of the frames' files, read three lines a band and labelled in tiles of five pixels."""
    bands = read_bands(list_files(spark, written_images(spark, sf)), band_bytes=3 * SIDE * 4)
    named = named_image_files(bands.withColumnRenamed("frame_id", "path"))
    named = named.withColumn("path", F.concat(F.lit("/raw/"), F.substring_index("path", "/", -1)))
    out = large_detections(
        named.withColumnRenamed("path", "frame_id"), DETECT, BRIGHT, SATURATED, tile=5
    ).withColumns({"n_positions": F.size("source_positions"), "n_photometry": F.size("photometry_data")})
    return rounded(out.drop("source_positions", "photometry_data"), *REPORT_NUMBERS)
