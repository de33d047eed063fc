"""Reduced analysis: files to a status and a few statistics, written as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framelake.operators.frames import ALL_NAN, NO_IMAGE, SUCCESS, light_stats
from framelake.sources.images import decode_frames
from framelake.sources.sinks import sink_text_rows

NO_DATA = "NO_DATA"
FIELDS = ["path", "status", "mean_value", "std_value", "num_objects"]


def reduced_analysis(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, status, mean, deviation and bright count of every file; failures carry zeros.

    The status is ``SUCCESS``, ``NO_DATA`` or ``ERROR_`` with the reason.
    """
    stats = light_stats(decode_frames(files, path, content).drop("height", "width"), "pixels")
    status = (
        F.when(F.col("status") == SUCCESS, SUCCESS)
        .when(F.col("status").isin(NO_IMAGE, ALL_NAN), NO_DATA)
        .otherwise(F.regexp_replace("status", "^ERR:", "ERROR_"))
    )
    return stats.select(F.col("frame_id").alias("path"), status.alias("status"), *FIELDS[2:])


def write_lines(rows: DataFrame, target: str) -> str:
    return sink_text_rows(rows, target, FIELDS)
