"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from framelake import registry  # noqa: E402
from framelake.plans.detection import detections  # noqa: E402
from framelake.plans.medallion import bronze  # noqa: E402
from framelake.registry.derived import image_bytes  # noqa: E402
from framelake.workspace import drop_run, materialize  # noqa: E402

RUNS = 3
HEADLINE = [
    "bronze_features", "detection_report", "source_catalog", "medallion_batch", "decode_frames",
    "silver_triplets", "catalog_report", "conditional_agg", "bucket_distribution",
    "best_worst_by_group", "rolling_pressure", "rolling_throughput", "top_k_per_group",
    "synthetic_table_profile", "live_gold_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("framelake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the session's executors and Python workers before the clock runs.
    registry.QUERIES["decode_frames"](spark, sf_dir).limit(1).collect()
    seconds = {}

    def timed(job) -> float:
        """Median of ``RUNS`` runs, the first of them cold."""
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        return round(statistics.median(taken), 3)

    for name in HEADLINE:
        seconds[name] = timed(lambda: registry.QUERIES[name](spark, sf_dir))
    # Files of the size of a survey cutout, 63 x 63, no two images alike; decoding is timed.
    cutouts = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.concat(F.lit("/raw/"), "vec_id", F.lit("_science.fits")).alias("path"), "embedding",
    )

    def encode(batches):
        for batch in batches:
            files = []
            for path, values in zip(batch.column(0), batch.column(1)):
                noise = np.random.default_rng(abs(hash(path.as_py())) % 2**32).normal(0, 0.3, 63 * 63)
                files.append(image_bytes(np.resize(np.asarray(values.values, np.float32), 63 * 63) + noise, 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    files = materialize(
        cutouts.repartition(int(cpus)).mapInArrow(encode, "path string, content binary"), "bench-files"
    )
    count = files.count()
    jobs = {
        "bronze_63x63": lambda: bronze(files),
        "detection_63x63": lambda: detections(files, detection_sigma=1.5, bright_sigma=2.5),
    }
    rates = {}
    for name, job in jobs.items():
        seconds[name] = timed(job)
        rates[f"{name}_files_per_second"] = round(count / seconds[name], 1)
    drop_run(spark)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        **rates,
    }))


if __name__ == "__main__":
    main()
