"""Streams over arriving files."""

from pyspark.sql import functions as F, types as T

from framelake import schemas
from framelake.functions.naming import image_type, object_id
from framelake.operators import frames as fr
from framelake.registry.base import query, rounded, sql_round as r, table
from framelake.registry.derived import named_frames
from framelake.registry.images import STORED_BRONZE_SQL
from framelake.registry.sources_sinks import written_images
from framelake.sources.manifest import MANIFEST, list_files
from framelake.sources.sinks import named_image_files
from framelake.streaming import live
from framelake.streaming.triplets import live_triplets
from framelake.workspace import materialize, new_folder


STORED_METRICS = ", ".join(schemas.BRONZE_METRICS)


def events(spark, sf):
    return live.stream_parquet(
        spark, f"{sf}/events.parquet", table(spark, sf, "events").schema
    )


@query("live_bronze_count", "SELECT count(*) AS bronze_rows FROM events")
def live_bronze_count(spark, sf):
    return live.live_bronze_count(events(spark, sf))


@query("live_gold_stats", f"""
SELECT count(*) AS gold_rows, {r("avg(user_id)")} AS avg_objects, max(value) AS max_quality FROM events""")
def live_gold_stats(spark, sf):
    return rounded(live.live_gold_stats(events(spark, sf), "user_id", "value"), "avg_objects")


@query("live_pending_gold", """
SELECT count(*) AS bronze_rows, CAST(NULL AS BIGINT) AS gold_rows, CAST(NULL AS DOUBLE) AS avg_objects,
       CAST(NULL AS DOUBLE) AS max_quality, 'pending' AS state FROM events
UNION ALL
SELECT count(*), count(*) FILTER (WHERE event_id % 2 = 0),
       round(avg(user_id) FILTER (WHERE event_id % 2 = 0), 6), max(value) FILTER (WHERE event_id % 2 = 0), 'ready' FROM events""")
def live_pending_gold(spark, sf):
    """The same monitor before the gold run and, restarted from its checkpoint, after it."""
    folder, state = new_folder(spark, "gold"), new_folder(spark, "monitor")
    rows = table(spark, sf, "events")
    rows.limit(0).write.parquet(folder)  # the folder is there before the run is
    watch = lambda: live.live_pending_gold(
        events(spark, sf), live.stream_parquet(spark, f"{folder}/run_*", rows.schema), "user_id", "value", state
    )
    before = materialize(watch(), "pending")
    rows.filter("event_id % 2 = 0").write.parquet(f"{folder}/run_1")
    return rounded(before.union(watch()), "avg_objects")


@query("live_bronze_ingest", f"""
SELECT object_id, image_type, median_bg, mean_sub, std_sub, bright_pixels, status FROM ({STORED_BRONZE_SQL})""")
def live_bronze_ingest(spark, sf):
    arriving = named_image_files(live.stream_images(spark, written_images(spark, sf)))
    rows = live.live_bronze_ingest(
        arriving, new_folder(spark, "live-bronze"), new_folder(spark, "live-bronze-checkpoint")
    )
    metrics = ["median_bg", "mean_sub", "std_sub"]
    out = rows.drop("file_path").withColumns({c: rows[c].cast("double") for c in metrics})
    return rounded(out, *metrics)


@query("live_manifest_ingest", f"""
SELECT object_id, image_type, median_bg, mean_sub, std_sub, bright_pixels, status FROM ({STORED_BRONZE_SQL})""")
def live_manifest_ingest(spark, sf):
    """Two listings of the same files arrive one after the other; each file becomes one row."""
    folder, images = new_folder(spark, "manifest"), written_images(spark, sf)
    target, checkpoint = new_folder(spark, "manifest-bronze"), new_folder(spark, "manifest-checkpoint")
    for _ in range(2):
        list_files(spark, images).write.mode("append").parquet(folder)
        rows = live.live_manifest_ingest(live.stream_parquet(spark, folder, MANIFEST), target, checkpoint)
    named = named_image_files(rows.withColumnRenamed("file_path", "path"))
    out = named.withColumns({c: named[c].cast("double") for c in ("median_bg", "mean_sub", "std_sub")})
    out = out.withColumns({"object_id": object_id("path"), "image_type": image_type("path")})
    return rounded(out.drop("path"), "median_bg", "mean_sub", "std_sub")


@query("live_triplets", f"""
WITH b AS (SELECT object_id, image_type, {STORED_METRICS} FROM ({STORED_BRONZE_SQL}))
SELECT d.object_id, {", ".join(f"{t}.{m} AS {name}_{m}" for t, name in zip("dst", schemas.IMAGE_TYPES) for m in schemas.BRONZE_METRICS)}
FROM b d JOIN b s USING (object_id) JOIN b t USING (object_id)
WHERE d.image_type = 'DIFFERENCE' AND s.image_type = 'SCIENCE' AND t.image_type = 'TEMPLATE'""")
def live_triplet_rows(spark, sf):
    """Bronze rows arrive in four parts that cut through objects, in two runs of the stream."""
    folder, target, checkpoint = (new_folder(spark, label) for label in ("arriving", "triplets", "triplets-checkpoint"))
    bronze = fr.bronze_features(named_frames(spark, sf), "path", "pixels").withColumn(
        "came", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("file_path"), F.lit(600))))
    schema = schemas.with_fields(schemas.BRONZE, came=T.TimestampType())
    bronze = materialize(bronze.select(*[F.col(f.name).cast(f.dataType) for f in schema]), "bronze")
    files = 0
    for parts in ((3, 0), (1, 2)):
        for part in parts:
            bronze.filter(F.pmod(F.xxhash64("file_path", F.lit(1)), F.lit(4)) == part).write.mode("append").parquet(folder)
        # A part is a batch, however many files it has: every batch looks through all that is kept.
        before, files = files, len(spark.read.schema(schema).parquet(folder).inputFiles())
        stream = live.stream_parquet(spark, folder, schema, files_per_batch=max(1, -(-(files - before) // len(parts))))
        rows = live_triplets(stream, "came", target, checkpoint)
    out = rows.filter("state = 'complete'").drop("state", "missing")
    metrics = [c for c in out.columns if c.endswith(("_bg", "_sub"))]
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in metrics}), *metrics)
