"""Per-image detection rows and the report over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framelake import schemas
from framelake.functions import naming, pixels as px
from framelake.functions.measures import MAD_TO_SIGMA, ratio_or_zero
from framelake.operators.aggregates import QUALITY_BUCKETS
from framelake.operators.frames import ALL_NAN, NO_IMAGE, SATURATION_LEVEL, SUCCESS
from framelake.operators.labeling import (
    BRIGHT_SIGMA,
    DETECTION_SIGMA,
    SOURCE,
    detect,
    source_lists,
    trace_batch,
)
from framelake.operators.relational import conform_to_schema
from framelake.sources.images import PIXELS_PER_BATCH, decoded

# What scales each quality factor to 1.
FULL_SNR = 100.0
FULL_SATURATION = 0.1
FULL_SOURCES = 100.0
FULL_RANGE = 60000.0
#: Characters of an error text in a detection row.
ERROR_TEXT = 50


def quality_score(brightest: str = "_max") -> Column:
    """Mean of the factors an image has: peak over noise (with noise), freedom from saturation,
    number of sources, dynamic range (if positive)."""
    snr = (F.col(brightest) - F.col("background_level")) / F.col("background_noise")
    one = F.lit(1.0)
    factors = [
        F.when(F.col("background_noise") > 0, F.least(snr / FULL_SNR, one)),
        one - F.least(F.col("saturation_fraction") / FULL_SATURATION, one),
        F.least(F.col("total_objects") / FULL_SOURCES, one),
        F.when(F.col("dynamic_range") > 0, F.least(F.col("dynamic_range") / FULL_RANGE, one)),
    ]
    present = sum(F.when(f.isNotNull(), 1.0).otherwise(0.0) for f in factors)
    return sum(F.coalesce(f, F.lit(0.0)) for f in factors) / present


def detection_report(
    frames: DataFrame,
    path: str,
    pixels: str,
    width: Column | str | int,
    status: str | None = None,
    detection_sigma: float = DETECTION_SIGMA,
    bright_sigma: float = BRIGHT_SIGMA,
    saturation_level: float = SATURATION_LEVEL,
    listed: int | None = None,
) -> DataFrame:
    """The full detection row of every image, with all its sources or the first ``listed``.

    Failed images carry zeros and a status.
    """
    width = F.lit(width) if isinstance(width, int) else (
        F.col(width) if isinstance(width, str) else width
    )
    rows = frames.select(
        F.col(path).alias("file_path"),
        width.alias("_w"),
        F.coalesce(F.size(F.col(pixels)), F.lit(0)).alias("_n_pixels"),
        (F.col(status) if status else F.lit(SUCCESS)).alias("_decoded"),
        F.col(pixels).alias("_pixels"),
    )
    found = detect(rows, "_pixels", "_w", detection_sigma, bright_sigma, saturation_level)
    return report_rows(found, listed)


def report_rows(found: DataFrame, listed: int | None = None) -> DataFrame:
    """Detection rows from what was found in each image: the columns of ``detect``, file_path, ``_n_pixels`` and
    ``_decoded``."""
    state = (
        F.when(~F.col("_decoded").isin(SUCCESS, NO_IMAGE, ALL_NAN),
               F.left(F.regexp_replace("_decoded", "^ERR:", "ERROR_"), F.lit(len("ERROR_") + ERROR_TEXT)))
        .when(F.col("_n_pixels") <= 0, "NO_IMAGE_DATA")
        .when(F.col("n_valid") <= 0, "ALL_NAN")
        .otherwise(SUCCESS)
    )
    positions, photometry = source_lists("sources", "background_noise", listed)
    found = px.stage(found, {"_state": state, "_score": quality_score()})
    good = F.col("_state") == SUCCESS
    number = lambda column: F.when(good, F.col(column)).otherwise(0)
    return found.select(
        "file_path",
        naming.telescope_id("file_path").alias("telescope_id"),
        naming.observation_time("file_path").alias("observation_time"),
        naming.type_from_substring("file_path").alias("image_type"),
        *[number(c).alias(c) for c in ("total_objects", "bright_sources", "faint_sources")],
        *[
            number(c).alias(c)
            for c in ("background_level", "background_noise", "dynamic_range", "saturation_fraction")
        ],
        positions.alias("source_positions"),
        photometry.alias("photometry_data"),
        number("_score").alias("quality_score"),
        F.col("_state").alias("processing_status"),
    )


#: What is found in an image file, as ``report_rows`` takes it.
FOUND = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("_n_pixels", T.IntegerType()),
    T.StructField("_decoded", T.StringType()), T.StructField("n_valid", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in (
        "background_level", "background_noise", "_max", "dynamic_range", "saturation_fraction")],
    *[T.StructField(c, T.IntegerType()) for c in ("total_objects", "bright_sources", "faint_sources")],
    T.StructField("sources", T.ArrayType(SOURCE)),
])


def _measured(image: np.ndarray | None, saturation_level: float) -> tuple:
    """n_pixels, n_valid, level, noise, maximum, range and saturated share."""
    if image is None:
        return 0, 0, None, None, None, None, None
    values = image[np.isfinite(image)].astype(np.float64)
    if not values.size:
        return image.size, 0, None, None, None, None, None
    level = float(np.median(values))
    noise = float(np.median(np.abs(values - level))) * MAD_TO_SIGMA
    top = float(values.max())
    return (image.size, values.size, level, noise, top, top - float(values.min()),
            float(np.count_nonzero(values >= saturation_level) / values.size))


def _found_batch(images: list[tuple], detection_sigma: float, bright_sigma: float, saturation_level: float) -> pa.RecordBatch:
    paths, pixels, states = zip(*images)
    measured = [_measured(image, saturation_level) for image in pixels]
    index, flux, faintest = [], [], min(detection_sigma, bright_sigma)
    for image, (_, _, level, noise, *_) in zip(pixels, measured):
        if not noise:  # none, or no positive one
            index.append(np.zeros(0, np.int32))
            flux.append(np.zeros(0))
            continue
        above = image.ravel().astype(np.float64) - level
        hot = np.flatnonzero(np.isfinite(above) & (above > noise * faintest))
        index.append(hot.astype(np.int32))
        flux.append(above[hot])
    ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int32))
    positions = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(index)))
    values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flux)))
    widths = pa.array([image.shape[1] if image is not None else 1 for image in pixels], pa.int32())

    def traced(sigma: float) -> pa.Array:
        return trace_batch(positions, values, widths, pa.array([m[3] * sigma if m[3] else None for m in measured], pa.float64()))

    total = traced(detection_sigma).value_lengths().to_numpy(zero_copy_only=False)
    sources = traced(bright_sigma)
    bright = sources.value_lengths().to_numpy(zero_copy_only=False)
    n_pixels, n_valid, *numbers = zip(*measured)
    columns = [
        pa.array(paths, pa.string()), pa.array(n_pixels, pa.int32()), pa.array(states, pa.string()), pa.array(n_valid, pa.int32()),
        *[pa.array(c, pa.float64()) for c in numbers],
        *[pa.array(c, pa.int32()) for c in (total, bright, total - bright)], sources,
    ]
    return pa.RecordBatch.from_arrays(columns, names=FOUND.fieldNames())


def decode_found(
    files: DataFrame, detection_sigma: float = DETECTION_SIGMA, bright_sigma: float = BRIGHT_SIGMA,
    saturation_level: float = SATURATION_LEVEL, path: str = "path", content: str = "content",
) -> DataFrame:
    """Files to what is found in them, one for one, where they are decoded: pixels do not leave the stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, size = [], 0
            for name, data in zip(batch.column(0), batch.column(1)):
                image, status = decoded(data.as_py())
                images.append((name.as_py(), image, status))
                size += 0 if image is None else image.size
                if size >= PIXELS_PER_BATCH:
                    yield _found_batch(images, detection_sigma, bright_sigma, saturation_level)
                    images, size = [], 0
            if images:
                yield _found_batch(images, detection_sigma, bright_sigma, saturation_level)

    return files.select(path, content).mapInArrow(run, FOUND)


def detections(files: DataFrame, listed: int | None = None, **thresholds) -> DataFrame:
    """Detection rows of image files. Tables that hold pixels already take ``detection_report``."""
    return conform_to_schema(report_rows(decode_found(files, **thresholds), listed), schemas.DETECTIONS)


def json_columns(rows: DataFrame) -> DataFrame:
    """The nested source lists as JSON text, for readers that want strings."""
    return rows.withColumns(
        {c: F.to_json(c) for c in ("source_positions", "photometry_data")}
    )


def detection_summary(rows: DataFrame, run_timestamp: str) -> DataFrame:
    """The report document: one row, from one scan of the detection rows.

    A first aggregate per image type is merged into totals, so a type that holds most rows is
    still counted where the rows are.
    """
    good = F.col("processing_status") == SUCCESS
    score = F.col("quality_score")
    per_type = rows.groupBy("image_type").agg(
        F.count(F.lit(1)).alias("_files"),
        F.count(F.when(good, 1)).alias("num_images"),
        F.avg(F.when(good, F.col("total_objects"))).alias("avg_objects"),
        F.avg(F.when(good, F.col("bright_sources"))).alias("avg_bright"),
        F.avg(F.when(good, score)).alias("avg_quality"),
        *[
            F.count(F.when((score >= low) & (score < high), 1)).alias(f"_q{i}")
            for i, (_, low, high) in enumerate(QUALITY_BUCKETS)
        ],
    )
    stats = F.struct("image_type", "num_images", "avg_objects", "avg_bright", "avg_quality")
    total = per_type.agg(
        F.coalesce(F.sum("_files"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("num_images"), F.lit(0)).alias("successful_files"),
        # One element per image type, of which there are four.
        F.sort_array(F.collect_list(F.when(F.col("num_images") > 0, stats))).alias("detection_stats"),
        *[F.coalesce(F.sum(f"_q{i}"), F.lit(0)).alias(f"_q{i}") for i in range(len(QUALITY_BUCKETS))],
    )
    buckets = [x for i, (name, _, _) in enumerate(QUALITY_BUCKETS)
               for x in (F.lit(name), F.col(f"_q{i}"))]
    return total.select(
        F.lit(run_timestamp).alias("processing_timestamp"),
        "total_files",
        "successful_files",
        ratio_or_zero("successful_files", "total_files").alias("success_rate"),
        "detection_stats",
        F.create_map(*buckets).alias("quality_distribution"),
    )
