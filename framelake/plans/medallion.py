"""Files to bronze features, to complete triplets per object, to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framelake import schemas
from framelake.operators import clustering
from framelake.operators.aggregates import silver_triplets
from framelake.operators.frames import SUCCESS, bronze_rows, frame_stats_lines
from framelake.operators.relational import conform_to_schema
from framelake.sources.images import decode_stats
from framelake.sources.sinks import sink_publish_run, sink_text_rows
from framelake.workspace import materialize


def bronze(files: DataFrame) -> DataFrame:
    """One row per file. The statistics are taken where the file is decoded, so no pixel leaves the
    Python worker; tables that hold pixels already take ``bronze_features``."""
    return conform_to_schema(bronze_rows(decode_stats(files), "frame_id"), schemas.BRONZE)


def stats_lines_run(files: DataFrame, target: str) -> str:
    """Four-field lines of every file, published as a run: complete or not there."""
    return sink_publish_run(frame_stats_lines(bronze(files)), target, sink_text_rows)


def silver(bronze_rows: DataFrame) -> DataFrame:
    return silver_triplets(
        bronze_rows, "object_id", "image_type", schemas.IMAGE_TYPES, schemas.BRONZE_METRICS,
        "file_path", F.col("status") == SUCCESS,
    )


def gold(silver_rows: DataFrame, k: int = 3, seed: int = 42, key: str = "object_id",
         features=tuple(clustering.FEATURES)):
    """Rows with raw and scaled features and their cluster, and the model."""
    # Written once: scaling reads it twice, and silver behind it is costly.
    assembled = materialize(clustering.assemble_features(silver_rows, features), "features")
    vectors = clustering.standardize(assembled)
    return clustering.kmeans_fit_assign(vectors, key, k=k, seed=seed)
