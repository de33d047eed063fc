"""Running views over arriving files, with Structured Streaming.

State is one global aggregate row per query. ``availableNow`` drains what has arrived and stops.
With a checkpoint folder of the caller's the next call goes on where this one stopped; without one,
each call counts from the start. Any other trigger stays live: the running query is returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from framelake import schemas
from framelake.operators.frames import SUCCESS
from framelake.plans.medallion import bronze
from framelake.sources.manifest import content_of
from framelake.workspace import new_folder

DRAIN = {"availableNow": True}


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType,
                   files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving at ``path``: a folder, a pattern, or one file."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and fs.getFileStatus(target).isFile():
        # The stream source watches folders: watch the file's folder for its name.
        reader = reader.option("pathGlobFilter", target.getName())
        path = target.getParent().toString()
    return reader.parquet(path)


def stream_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def stream_images(spark: SparkSession, path: str, recursive: bool = True,
                  files_per_batch: int | None = None) -> DataFrame:
    """Image files arriving below ``path``. Limit the batch when a large backlog is waiting."""
    reader = (
        spark.readStream.format("binaryFile").schema(schemas.RAW_FILES)
        .option("recursiveFileLookup", str(recursive).lower())
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drains(trigger: Mapping) -> bool:
    """Whether a trigger stops when what has arrived is done."""
    return bool(trigger.get("availableNow") or trigger.get("once"))


def _latest(stream: DataFrame, label: str, trigger: Mapping,
            checkpoint: str | None = None) -> DataFrame | StreamingQuery:
    """Run a global aggregate in complete mode and return its last result, or the live query.

    The result is one row, so the in-memory table that keeps it stays that small however much
    arrives. It is written beside the checkpoint: a restart without new data gives the last result.
    No data at all gives an empty table. A live query's results are in the table of its name.
    """
    spark = stream.sparkSession
    folder = checkpoint or new_folder(spark, f"{label}-checkpoint")
    name = f"{label}_{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(**trigger).start()
    )
    if not drains(trigger):
        return query
    query.awaitTermination()
    found, last = spark.table(name), f"{folder}/last"
    if not found.isEmpty():
        found.write.mode("overwrite").parquet(last)
    path = spark._jvm.org.apache.hadoop.fs.Path(last)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return found
    return spark.read.schema(found.schema).parquet(last)


def live_bronze_count(rows: DataFrame, out: str = "bronze_rows", trigger: Mapping = DRAIN,
                      checkpoint: str | None = None):
    return _latest(rows.agg(F.count(F.lit(1)).alias(out)), "bronze_count", trigger, checkpoint)


def live_gold_stats(rows: DataFrame, objects: str, quality: str, trigger: Mapping = DRAIN,
                    checkpoint: str | None = None, valid: Column | None = None):
    """Count, mean objects and best quality; of rows that meet ``valid``, if given."""
    rows = rows if valid is None else rows.filter(valid)
    stats = rows.agg(
        F.count(F.lit(1)).alias("gold_rows"),
        F.avg(objects).alias("avg_objects"),
        F.max(quality).alias("max_quality"),
    )
    return _latest(stats, "gold_stats", trigger, checkpoint)


def live_pending_gold(bronze_rows: DataFrame, gold_rows: DataFrame, objects: str, quality: str,
                      checkpoint: str | None = None) -> DataFrame:
    """The monitor line: bronze count, gold statistics if any, and ``ready`` or ``pending``."""
    below = lambda part: f"{checkpoint}/{part}" if checkpoint else None
    done = live_bronze_count(bronze_rows, checkpoint=below("bronze"))
    gold = live_gold_stats(gold_rows, objects, quality, checkpoint=below("gold"))
    # Two one-row tables side by side; the right one may be empty.
    return (
        done.withColumn("_one", F.lit(1))
        .join(gold.withColumn("_one", F.lit(1)), "_one", "left")
        .select(
            "bronze_rows", "gold_rows", "avg_objects", "max_quality",
            F.when(F.col("gold_rows") > 0, "ready").otherwise("pending").alias("state"),
        )
    )


def live_bronze_ingest(files: DataFrame, target: str, checkpoint: str, trigger: Mapping = DRAIN):
    """Turn arriving image files into bronze rows in ``target``, each file once.

    The checkpoint remembers the files already taken: starting again continues with new ones. A
    trigger that stays live gives the running query.
    """
    query = (
        bronze(files).writeStream.outputMode("append").format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )
    if not drains(trigger):
        return query
    query.awaitTermination()
    return files.sparkSession.read.schema(schemas.BRONZE).parquet(target)


def live_manifest_ingest(manifest: DataFrame, target: str, checkpoint: str, event_time: str = "modificationTime",
                         delay: str = "7 days", trigger: Mapping = DRAIN):
    """Turn the files of arriving manifest rows into bronze rows in ``target``, each file once.

    The stream's own log names manifest files, not images. A path that is listed again within ``delay`` of
    ``event_time`` is dropped, across restarts; Spark forgets older paths, whose rows it drops as late. Bytes
    are read where the rows are.
    """
    listed = manifest.filter(F.col("status") == SUCCESS).withWatermark(event_time, delay)
    files = content_of(listed.dropDuplicatesWithinWatermark(["path"]))
    query = (
        bronze(files).writeStream.outputMode("append").format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )
    if not drains(trigger):
        return query
    query.awaitTermination()
    return manifest.sparkSession.read.schema(schemas.BRONZE).parquet(target)
