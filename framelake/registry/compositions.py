"""Whole runs from derived files to reports."""

from pyspark.sql import Window, functions as F

from framelake import schemas
from framelake.functions.measures import percent_of
from framelake.operators.aggregates import QUALITY_BUCKETS
from framelake.operators import clustering
from framelake.operators.aggregates import condition_counts
from framelake.plans import catalog as cat, detection, diagnostics, medallion, reduced
from framelake.plans.runs import run_job
from framelake.registry.base import query, rounded, sql_round as r
from framelake.operators.relational import split_fields
from framelake.registry.derived import FRAME_PATH, FRAME_STATS_SQL, PATHS_SQL, image_files, paths
from framelake.registry.images import BRIGHT, DETECT, LIGHT_SQL, REPORT_SQL, SATURATED, STORED_BRONZE_SQL
from framelake.registry.names import CLASS, DATE, HSC_CLASS, RUN10, RUN6, BAND, bucket_sql
from framelake.registry.rows import SCORES_SQL, scores
from framelake.sources.specs import HSC, HSC_DETECTORS, ZTF
from framelake.workspace import materialize, new_folder

METRICS = ["median_bg", "mean_sub", "std_sub"]
SILVER_COLUMNS = [f"{kind}_{m}" for kind in schemas.IMAGE_TYPES for m in METRICS]


def as_doubles(df, columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("medallion_batch", f"""
WITH b AS MATERIALIZED ({STORED_BRONZE_SQL})
SELECT d.object_id, """ + ", ".join(
    f"{k[0].lower()}.{m} AS {k}_{m}"
    for k in schemas.IMAGE_TYPES for m in schemas.BRONZE_METRICS
) + """
FROM b d JOIN b s USING (object_id) JOIN b t USING (object_id)
WHERE d.image_type = 'DIFFERENCE' AND s.image_type = 'SCIENCE' AND t.image_type = 'TEMPLATE'""")
def medallion_batch(spark, sf):
    """Decode, bronze and silver, each written once and read back by the next."""
    bronze = materialize(medallion.bronze(image_files(spark, sf)), "bronze")
    silver = materialize(medallion.silver(bronze), "silver")
    return rounded(as_doubles(silver, SILVER_COLUMNS), *SILVER_COLUMNS)


@query("medallion_gold", f"""
WITH b AS MATERIALIZED ({STORED_BRONZE_SQL}),
     k AS (SELECT DISTINCT object_id FROM b)
SELECT object_id, ['Background detections', 'Noise/artifacts', 'High-intensity transient candidates'][CAST(object_id AS BIGINT) // 3 % 3 + 1] AS cluster_name
FROM k WHERE 3 = (SELECT count(DISTINCT image_type) FROM b WHERE b.object_id = k.object_id)""")
def medallion_gold(spark, sf):
    """Features moved apart by object, so that the clusters are known."""
    silver = materialize(medallion.silver(medallion.bronze(image_files(spark, sf))), "silver")
    group = F.floor(F.col("object_id").cast("bigint") / 3) % 3 * 100_000
    moved = silver.withColumns({c: F.col(c) + group for c in clustering.FEATURES})
    rows, model = medallion.gold(moved)
    return clustering.cluster_names(rows, model).select("object_id", "cluster_name")


BUCKET_COLUMNS = ", ".join(
    f"count(*) FILTER (WHERE quality_score >= {low} AND quality_score < {high}) AS {name.lower()}"
    for name, low, high in QUALITY_BUCKETS
)


@query("detection_batch", f"""
{REPORT_SQL}
SELECT count(*) AS total_files, count(*) AS successful_files, 1.0::DOUBLE AS success_rate,
       CAST(3 AS INTEGER) AS types, {BUCKET_COLUMNS},
       {r("avg(total_objects) FILTER (WHERE file_path LIKE '%science%')")} AS science_objects,
       {r("avg(bright_sources) FILTER (WHERE file_path LIKE '%science%')")} AS science_bright
FROM report""")
def detection_batch(spark, sf):
    rows = materialize(
        detection.detections(
            image_files(spark, sf), detection_sigma=DETECT, bright_sigma=BRIGHT,
            saturation_level=SATURATED,
        ),
        "detections",
    )
    summary = detection.detection_summary(rows, "20251012_153354")
    science = F.get(F.filter("detection_stats", lambda s: s["image_type"] == "SCIENCE"), 0)
    out = summary.select(
        "total_files", "successful_files", "success_rate", F.size("detection_stats").alias("types"),
        *[F.col("quality_distribution")[name].alias(name.lower()) for name, _, _ in QUALITY_BUCKETS],
        science["avg_objects"].alias("science_objects"),
        science["avg_bright"].alias("science_bright"),
    )
    return rounded(out, "science_objects", "science_bright")


@query("detection_conditions", f"""
{REPORT_SQL}
SELECT count(*) FILTER (WHERE background_noise <= 0) AS zero_background_noise,
       count(*) FILTER (WHERE dynamic_range <= 0) AS zero_dynamic_range,
       count(*) FILTER (WHERE total_objects = 0) AS zero_objects,
       count(*) FILTER (WHERE saturation_fraction IS NULL) AS null_saturation FROM report""")
def detection_conditions(spark, sf):
    rows = detection.detections(
        image_files(spark, sf), detection_sigma=DETECT, bright_sigma=BRIGHT, saturation_level=SATURATED
    )
    return condition_counts(rows, diagnostics.detection_conditions())


@query("reduced_analysis", f"""
SELECT path, CASE WHEN vec_id % 10 = 0 THEN 'ERROR' WHEN vec_id % 10 = 1 THEN 'NO_DATA' ELSE 'SUCCESS' END AS status,
       CASE WHEN vec_id % 10 > 1 THEN {r("mean_value")} ELSE 0 END AS mean_value,
       CASE WHEN vec_id % 10 > 1 THEN {r("std_value")} ELSE 0 END AS std_value,
       CASE WHEN vec_id % 10 > 1 THEN num_objects ELSE 0 END AS num_objects, true AS in_lines
FROM (SELECT *, {FRAME_PATH} AS path FROM {LIGHT_SQL})""")
def reduced_analysis(spark, sf):
    """Files to statistics to lines, some files broken and some without an image."""
    key = F.col("vec_id") % 10
    empty = F.rpad(F.concat(*[F.rpad(F.lit(c), 80, " ") for c in EMPTY_CARDS]), 2880, " ").cast("binary")
    files = image_files(spark, sf).withColumn(
        "content", F.when(key == 0, F.lit(b"broken")).when(key == 1, empty).otherwise(F.col("content"))
    )
    rows = materialize(reduced.reduced_analysis(files), "reduced")
    lines = spark.read.text(reduced.write_lines(rows, new_folder(spark, "reduced-lines")))
    written = lines.select(F.split_part("value", F.lit(","), F.lit(1)).alias("line_path")).distinct()
    out = rows.join(written, F.col("path") == F.col("line_path"), "left").select(
        "path", F.regexp_replace("status", "^ERROR_.*", "ERROR").alias("status"), "mean_value", "std_value",
        "num_objects", F.col("line_path").isNotNull().alias("in_lines"),
    )
    return rounded(out, "mean_value", "std_value")


@query("stats_lines_run", f"""
SELECT file_path AS path, {r("mean_sub", 4)} AS mean_sub, {r("std_sub", 4)} AS std_sub, CAST(bright_pixels AS VARCHAR) AS bright
FROM (SELECT *, {FRAME_PATH} AS file_path FROM {FRAME_STATS_SQL})""")
def stats_lines_run(spark, sf):
    """Decode, statistics, four-field lines, published as a run and read back."""
    target = medallion.stats_lines_run(image_files(spark, sf), new_folder(spark, "stats-lines"))
    fields = split_fields(spark.read.text(target), "value", ["path", "mean_sub", "std_sub", "bright"])
    out = fields.withColumns({c: F.col(c).cast("double") for c in ("mean_sub", "std_sub")})
    return rounded(out, "mean_sub", "std_sub", digits=4)


EMPTY_CARDS = [
    "SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "END",
]


CATALOG_ROWS_SQL = f"""
(SELECT path AS file_path, 'ZTF' AS telescope, {CLASS} AS data_type, {DATE} AS observation_date,
        CAST(substr({RUN6}, 1, 3) AS INTEGER) AS field_id, CAST(NULL AS INTEGER) AS detector_id,
        {BAND} AS filter_band, CAST({RUN10} AS BIGINT) AS exposure_id
 FROM {PATHS_SQL} WHERE NOT contains(path, 'HSC')
 UNION ALL
 SELECT path, 'HSC', {HSC_CLASS}, NULL, NULL, {bucket_sql(HSC_DETECTORS)}, NULL, NULL
 FROM {PATHS_SQL} WHERE contains(path, 'HSC'))"""


def catalog_rows(spark, sf):
    files = paths(spark, sf).withColumn("length", F.length("path").cast("bigint") * 1024)
    hsc = F.col("path").contains("HSC")
    return cat.catalog(
        [(ZTF, files.filter(~hsc)), (HSC, files.filter(hsc))], "2025-10-12T15:33:54"
    )


@query("catalog_batch", f"""
SELECT file_path, telescope, data_type, observation_date, field_id, detector_id, filter_band,
       exposure_id, {r("length(file_path) / 1024.0")} AS file_size_mb,
       '2025-10-12T15:33:54' AS processing_timestamp, CAST(NULL AS VARCHAR) AS quality_flags
FROM {CATALOG_ROWS_SQL}""")
def catalog_batch(spark, sf):
    return rounded(as_doubles(catalog_rows(spark, sf), ["file_size_mb"]), "file_size_mb")


def missing_sql(column):
    return f"count(*) FILTER (WHERE {column} IS NULL)"


@query("catalog_report", f"""
SELECT count(*) AS total_files, count(*) FILTER (WHERE telescope = 'ZTF' AND NOT contains(file_path, 'plain')) AS ztf,
       count(*) FILTER (WHERE telescope = 'HSC') AS hsc,
       count(*) FILTER (WHERE contains(file_path, 'plain')) AS unknown, {missing_sql("field_id")} AS missing_field_id,
       {missing_sql("filter_band")} AS missing_filter_band,
       {r("100.0 * " + missing_sql("exposure_id") + " / count(*)")} AS missing_exposure_percent
FROM {CATALOG_ROWS_SQL}""")
def catalog_report(spark, sf):
    rows = catalog_rows(spark, sf).withColumn(
        "telescope", F.when(~F.col("file_path").contains("plain"), F.col("telescope"))
    )
    report = cat.quality_report(rows, "20251012_153354")
    metric = lambda name: F.col("quality_metrics")[f"missing_{name}"]
    out = report.select(
        "total_files",
        F.col("telescope_distribution")["ZTF"].alias("ztf"),
        F.col("telescope_distribution")["HSC"].alias("hsc"),
        F.col("telescope_distribution")["UNKNOWN"].alias("unknown"),
        metric("field_id")["missing_count"].alias("missing_field_id"),
        metric("filter_band")["missing_count"].alias("missing_filter_band"),
        metric("exposure_id")["missing_percentage"].alias("missing_exposure_percent"),
    )
    return rounded(out, "missing_exposure_percent")


@query("quality_diagnostic", f"""
SELECT event_type, count(*) AS total_count,
       count(*) FILTER (WHERE isnan(score) OR score IS NULL) AS nan_count,
       {r("avg(score) FILTER (WHERE NOT isnan(score))")} AS avg_valid,
       (SELECT count(*) FILTER (WHERE score <= 10) FROM {SCORES_SQL} WHERE event_type = 'click') AS low_clicks,
       (SELECT min(event_id) FROM {SCORES_SQL} WHERE event_type = 'click' AND NOT isnan(score)) AS first_valid
FROM {SCORES_SQL} GROUP BY event_type""")
def quality_diagnostic(spark, sf):
    """Profile, condition counts and the first valid row in focus, all from one scan."""
    click = F.col("event_type") == "click"
    per_type = diagnostics.profile_with_conditions(
        scores(spark, sf), "event_type", "score", click, {"low": F.col("score") <= 10}, first="event_id")
    # One row per event type: the totals over types stay in one small window.
    over_types = Window.partitionBy(F.lit(1))
    out = per_type.select(
        "event_type", "total_count", "nan_count", "avg_valid",
        F.sum("low").over(over_types).alias("low_clicks"), F.min("first_valid").over(over_types).alias("first_valid"),
    )
    return rounded(out, "avg_valid")


@query("pluggable_job", f"""
SELECT o_custkey, count(*) AS n, {r("100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)")} AS percent
FROM orders GROUP BY o_custkey""")
def pluggable_job(spark, sf):
    def share(session, path, key, done):
        good = F.count(F.when(F.col("o_orderstatus") == done, 1))
        return session.read.parquet(path).groupBy(key).agg(
            F.count(F.lit(1)).alias("n"),
            percent_of(good, F.count(F.lit(1))).alias("percent"),
        )

    out = run_job(spark, share, f"{sf}/orders.parquet", key="o_custkey", done="F")
    return rounded(out, "percent")
