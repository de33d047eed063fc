"""Inputs that Spark derives from the driver's tables: frames, file paths, image files, alerts.

Text shared with the SQL twins is kept here, so both sides start from the same rows.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from framelake import schemas
from framelake.registry.base import table

SIDE = 8
#: Files handed over at a time: a file has twenty times the bytes of its frame.
FILES_PER_BATCH = 500

# A path per order: ten digits spread over the key space, a kind, some names without either.
PATH = """
CASE WHEN o_orderkey % 17 = 0 THEN '/raw/plain.fits'
     WHEN o_orderkey % 19 = 0 THEN '/raw/HSCA' || CAST(o_orderkey AS STRING) || '.fits'
     ELSE '/raw/' || lpad(CAST((o_orderkey % 1000000007) * 982451653 % 10000000000 AS STRING), 10, '0')
          || CASE o_orderstatus WHEN 'F' THEN '_science' WHEN 'O' THEN '_template'
             ELSE '_difference' END || '.fits' END
"""
PATHS_SQL = f"(SELECT o_orderkey, {PATH} AS path FROM orders)"

# Three images per object from the frames of three successive ids.
FRAME_PATH = """
'/raw/' || CAST(vec_id - vec_id % 3 AS STRING)
|| CASE vec_id % 3 WHEN 0 THEN '_science' WHEN 1 THEN '_template' ELSE '_difference' END || '.fits'
"""

PIXELS_SQL = """
(SELECT vec_id, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x, v
 FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos,
              CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))
"""
SUBTRACTED_SQL = f"""
(SELECT p.vec_id, y, x, v, v - med AS sub, med
 FROM {PIXELS_SQL} p JOIN (SELECT vec_id, median(v) AS med FROM {PIXELS_SQL} GROUP BY vec_id) m
 ON p.vec_id = m.vec_id)
"""
FRAME_STATS_SQL = f"""
(SELECT s.vec_id, max(med) AS median_bg, max(mean) AS mean_sub, max(sd) AS std_sub,
        CAST(count(*) FILTER (WHERE sub > mean + 3 * sd) AS INTEGER) AS bright_pixels
 FROM {SUBTRACTED_SQL} s
 JOIN (SELECT vec_id, avg(sub) AS mean, stddev_pop(sub) AS sd FROM {SUBTRACTED_SQL} GROUP BY vec_id) t
 ON s.vec_id = t.vec_id GROUP BY s.vec_id)
"""
NOISE_SQL = f"""
(SELECT vec_id, max(med) AS background_level, 1.4826 * median(abs(sub)) AS background_noise,
        max(v) AS brightest, max(v) - min(v) AS dynamic_range,
        count(*) FILTER (WHERE v >= {{saturation}}) / count(*) AS saturation_fraction
 FROM {SUBTRACTED_SQL} GROUP BY vec_id)
"""


def noise_sql(saturation: float = 65000.0) -> str:
    return NOISE_SQL.format(saturation=saturation)


def hot_sql(sigma: float) -> str:
    """Pixels above ``sigma`` noise units, with their value above background."""
    return f"""
    (SELECT s.vec_id, y, x, sub, background_noise
     FROM {SUBTRACTED_SQL} s JOIN {noise_sql()} n ON s.vec_id = n.vec_id
     WHERE background_noise > 0 AND sub > {sigma} * background_noise)
    """


def labeled_sql(sigma: float, name: str) -> str:
    """Recursive CTEs ``<name>_hot`` and ``<name>``: hot pixels with the root of their region."""
    return f"""
    {name}_hot AS MATERIALIZED (SELECT *, y * {SIDE} + x AS pos FROM {hot_sql(sigma)}),
    {name}_reach AS (
        SELECT vec_id, y, x, pos AS root FROM {name}_hot
        UNION
        SELECT h.vec_id, h.y, h.x, r.root FROM {name}_reach r JOIN {name}_hot h
        ON h.vec_id = r.vec_id AND abs(h.y - r.y) <= 1 AND abs(h.x - r.x) <= 1),
    {name} AS (
        SELECT h.vec_id, h.y, h.x, h.sub, h.background_noise, m.root
        FROM {name}_hot h
        JOIN (SELECT vec_id, y, x, min(root) AS root FROM {name}_reach GROUP BY ALL) m
        ON h.vec_id = m.vec_id AND h.y = m.y AND h.x = m.x)
    """


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and pixels of an 8 x 8 image."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("pixels"))


def named_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("path", F.expr(FRAME_PATH))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.expr(PATH).alias("path"))


def image_bytes(pixels: np.ndarray, side: int = SIDE) -> bytes:
    cards = [
        "SIMPLE  =                    T",
        "BITPIX  =                  -32",
        "NAXIS   =                    2",
        f"NAXIS1  = {side:>20}",
        f"NAXIS2  = {pixels.size // side:>20}",
        "END",
    ]
    header = "".join(card.ljust(80) for card in cards).encode("ascii")
    data = pixels.astype(">f4").tobytes()
    return header.ljust(-(-len(header) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def encoded(gzipped: bool):
    """A function over Arrow batches of named frames that makes image files of them, ``FILES_PER_BATCH`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, FILES_PER_BATCH) for b in batches for at in range(0, b.num_rows, FILES_PER_BATCH)):
            files = [
                image_bytes(np.asarray(row.values, np.float32)) for row in batch.column("pixels")
            ]
            if gzipped:
                # Two members each, as concatenated streams have.
                files = [gzip.compress(d[:2880], mtime=0) + gzip.compress(d[2880:], mtime=0) for d in files]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("path"), pa.array(files, pa.binary())],
                names=["vec_id", "path", "content"],
            )

    return run


def image_files(spark: SparkSession, sf_dir: str, gzipped: bool = False) -> DataFrame:
    """vec_id, path and the bytes of an image file per frame."""
    return named_frames(spark, sf_dir).mapInArrow(
        encoded(gzipped), schemas.struct(vec_id=schemas.BIGINT, path=schemas.STRING, content=schemas.BINARY)
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per frame; some stamps are absent or empty, some ids only in alertId, some nowhere."""
    files = image_files(spark, sf_dir, gzipped=True)
    key = F.col("vec_id")
    stamp = lambda present: F.when(present, F.struct(F.col("content").alias("stampData")))
    empty = F.struct(F.lit(b"").alias("stampData"))
    return files.select(
        F.when(key % 5 == 0, 0).when(key % 5 != 1, key + 1).alias("candid"),
        F.when(key % 35 == 0, 0).otherwise(key + 1).alias("alertId"),
        stamp(key >= 0).alias("cutoutScience"),
        stamp(key % 7 != 0).alias("cutoutTemplate"),
        F.when(key % 11 == 0, empty).otherwise(stamp(key >= 0)).alias("cutoutDifference"),
    )
