"""Detection rows of images too large for one row, from bands of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framelake.functions.measures import mask_non_finite
from framelake.operators.frames import SATURATION_LEVEL, SUCCESS
from framelake.operators.history import top_k_per_group
from framelake.operators.labeling import (
    BRIGHT_SIGMA, DETECTION_SIGMA, SOURCE, label_pixels, measure_sources,
)
from framelake.operators.selection import background_noise_long
from framelake.plans.detection import report_rows
from framelake.sources.bands import band_pixels
from framelake.workspace import materialize

#: Sources that a detection row lists; ``large_sources`` has them all.
LISTED = 20
KEY = ["file_path"]


def _above(pixels: DataFrame, noise: DataFrame, sigma: float) -> DataFrame:
    """Pixels more than ``sigma`` noise units above their image's background, in images with noise."""
    rows = pixels.join(noise.select("file_path", "background_level", "background_noise"), "file_path")
    above = F.col("v") - F.col("background_level")
    hot = rows.filter((F.col("background_noise") > 0) & (above > F.col("background_noise") * float(sigma)))
    return hot.select("file_path", "y", "x", above.alias("above"), "background_noise")


def large_sources(pixels: DataFrame, noise: DataFrame, sigma: float, tile: int = 512) -> DataFrame:
    """One row per region above ``sigma`` noise units: file_path, source (its first pixel in raster order) and measures."""
    hot = materialize(_above(pixels, noise, sigma), "hot-pixels")
    return measure_sources(label_pixels(hot, KEY, tile), KEY, "above")


def large_detections(
    bands: DataFrame,
    detection_sigma: float = DETECTION_SIGMA,
    bright_sigma: float = BRIGHT_SIGMA,
    saturation_level: float = SATURATION_LEVEL,
    listed: int = LISTED,
    tile: int = 512,
) -> DataFrame:
    """The row that ``detection_report`` gives, for images of any size, with the first ``listed`` bright sources.

    No task sees more of an image than a band, a tile or a row per bucket of its values. An image of which
    any band failed has zeros and that band's status.
    """
    bands = materialize(bands.withColumnRenamed("frame_id", "file_path"), "bands")
    size = F.col("height").cast("bigint") * F.col("width")
    failed = F.max(F.when(F.col("status") != SUCCESS, F.col("status")))
    images = bands.groupBy("file_path").agg(
        F.max(size).alias("_n_pixels"), F.coalesce(failed, F.lit(SUCCESS)).alias("_decoded"))
    pixels = band_pixels(bands.withColumnRenamed("file_path", "frame_id")).withColumnRenamed("frame_id", "file_path")
    pixels = pixels.withColumn("v", mask_non_finite("v"))
    noise = materialize(background_noise_long(pixels, KEY, "v"), "noise")
    spans = pixels.groupBy("file_path").agg(
        F.max("v").alias("_max"), (F.max("v") - F.min("v")).alias("dynamic_range"),
        F.avg(F.when(F.col("v") >= saturation_level, 1.0).when(F.col("v").isNotNull(), 0.0)).alias("saturation_fraction"))
    finite = pixels.filter(F.col("v").isNotNull())
    counted = large_sources(finite, noise, detection_sigma, tile).groupBy("file_path").agg(
        F.count(F.lit(1)).cast("int").alias("total_objects"))
    bright = materialize(large_sources(finite, noise, bright_sigma, tile), "bright-sources")
    # ``listed`` sources an image at most.
    first = top_k_per_group(bright, KEY, ["source"], listed, "label").groupBy("file_path").agg(
        F.sort_array(F.collect_list(F.struct(F.col("label").cast("int").alias("label"), *SOURCE.fieldNames()[1:]))).alias("sources"))
    numbers = bright.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("bright_sources"))
    found = images
    for part in (noise, spans, counted, numbers, first):
        found = found.join(part, "file_path", "left")
    found = found.withColumns({
        "n_valid": F.coalesce("n_valid", F.lit(0)),
        "total_objects": F.coalesce("total_objects", F.lit(0)),
        "bright_sources": F.coalesce("bright_sources", F.lit(0)),
        "sources": F.coalesce("sources", F.array().cast(f"array<{SOURCE.simpleString()}>")),
    })
    found = found.withColumn("faint_sources", F.col("total_objects") - F.col("bright_sources"))
    return report_rows(materialize(found, "found"))
