"""Image operators on 8 x 8 frames."""

from pyspark.sql import functions as F

from framelake.operators import frames as fr, labeling as lab
from framelake.plans.detection import detection_report
from framelake.registry.base import query, rounded, sql_round as r
from framelake.registry.derived import (
    FRAME_PATH,
    FRAME_STATS_SQL,
    PIXELS_SQL,
    SIDE,
    SUBTRACTED_SQL,
    alerts,
    frames,
    hot_sql,
    image_files,
    labeled_sql,
    named_frames,
    noise_sql,
)
from framelake.sources.images import decode_frames, explode_cutouts, inflate_stamps, map_files
from framelake import schemas

# Thresholds that find sources in these frames.
DETECT, BRIGHT, SATURATED = 1.5, 2.5, 0.2


@query("pixel_explode", f"SELECT vec_id, y, x, v FROM {PIXELS_SQL}")
def pixel_explode(spark, sf):
    return fr.pixel_explode(frames(spark, sf), ["vec_id"], "pixels", SIDE)


@query("frame_median", f"""
SELECT vec_id, {r("median(v)")} AS median_bg FROM {PIXELS_SQL} GROUP BY vec_id""")
def frame_median(spark, sf):
    out = fr.frame_median(frames(spark, sf), "pixels").drop("pixels")
    return rounded(out, "median_bg")


@query("background_subtract", f"SELECT vec_id, y, x, {r('sub')} AS sub FROM {SUBTRACTED_SQL}")
def background_subtract(spark, sf):
    leveled = fr.background_subtract(frames(spark, sf), "pixels")
    out = fr.pixel_explode(leveled, ["vec_id"], "subtracted", SIDE)
    return rounded(out.withColumnRenamed("v", "sub"), "sub")


@query("frame_mean_std", f"""
SELECT vec_id, {r("mean_sub")} AS mean_sub, {r("std_sub")} AS std_sub FROM {FRAME_STATS_SQL}""")
def frame_mean_std(spark, sf):
    out = fr.frame_stats(frames(spark, sf), "pixels")
    return rounded(out.select("vec_id", "mean_sub", "std_sub"), "mean_sub", "std_sub")


@query("three_sigma_count", f"SELECT vec_id, bright_pixels FROM {FRAME_STATS_SQL}")
def three_sigma_count(spark, sf):
    return fr.frame_stats(frames(spark, sf), "pixels").select("vec_id", "bright_pixels")


# What a float column holds, as a double.
STORED_SQL = """
SELECT vec_id, CAST(CAST(median_bg AS FLOAT) AS DOUBLE) AS median_bg,
       CAST(CAST(mean_sub AS FLOAT) AS DOUBLE) AS mean_sub,
       CAST(CAST(std_sub AS FLOAT) AS DOUBLE) AS std_sub, bright_pixels FROM {stats}"""
BRONZE_SQL = f"""
SELECT path AS file_path, split_part(regexp_extract(path, '[^/]*$'), '_', 1) AS object_id,
       upper(replace(split_part(regexp_extract(path, '[^/]*$'), '_', 2), '.fits', '')) AS image_type,
       {r("median_bg")} AS median_bg, {r("mean_sub")} AS mean_sub, {r("std_sub")} AS std_sub,
       bright_pixels, 'SUCCESS' AS status
FROM (SELECT vec_id, {FRAME_PATH} AS path FROM embeddings) JOIN {FRAME_STATS_SQL} USING (vec_id)"""
STORED_BRONZE_SQL = BRONZE_SQL.replace(
    FRAME_STATS_SQL, f"({STORED_SQL.format(stats=FRAME_STATS_SQL)})"
)


@query("bronze_features", BRONZE_SQL)
def bronze_features(spark, sf):
    out = fr.bronze_features(named_frames(spark, sf), "path", "pixels")
    return rounded(out, "median_bg", "mean_sub", "std_sub")


@query("frame_stats_lines", f"""
SELECT file_path AS path, mean_sub, std_sub, CAST(bright_pixels AS VARCHAR) AS bright_or_error
FROM ({BRONZE_SQL})""")
def frame_stats_lines(spark, sf):
    bronze = fr.bronze_features(named_frames(spark, sf), "path", "pixels")
    return rounded(fr.frame_stats_lines(bronze), "mean_sub", "std_sub")


@query("mad_noise", f"""
SELECT vec_id, {r("background_level")} AS background_level, {r("background_noise")} AS background_noise
FROM {noise_sql()}""")
def mad_noise(spark, sf):
    out = fr.mad_noise(frames(spark, sf), "pixels").drop("n_valid")
    return rounded(out, "background_level", "background_noise")


@query("dynamic_range", f"SELECT vec_id, {r('dynamic_range')} AS dynamic_range FROM {noise_sql()}")
def dynamic_range(spark, sf):
    return rounded(fr.dynamic_range(frames(spark, sf), "pixels"), "dynamic_range")


@query("saturation_fraction", f"""
SELECT vec_id, {r("saturation_fraction")} AS saturation_fraction FROM {noise_sql(SATURATED)}""")
def saturation_fraction(spark, sf):
    out = fr.saturation_fraction(frames(spark, sf), "pixels", SATURATED)
    return rounded(out, "saturation_fraction")


@query("sigma_mask", f"SELECT vec_id, y, x, {r('sub')} AS above FROM {hot_sql(DETECT)}")
def sigma_mask(spark, sf):
    return rounded(
        fr.sigma_mask(frames(spark, sf), ["vec_id"], "pixels", SIDE, DETECT), "above"
    )


@query("connected_sources", f"""
WITH RECURSIVE {labeled_sql(DETECT, "d")}
SELECT vec_id, CAST(count(DISTINCT root) AS INTEGER) AS n_sources
FROM embeddings LEFT JOIN d USING (vec_id) GROUP BY vec_id""")
def connected_sources(spark, sf):
    return lab.connected_sources(frames(spark, sf), "pixels", SIDE, DETECT)


@query("source_counts", f"""
WITH RECURSIVE {labeled_sql(DETECT, "d")}, {labeled_sql(BRIGHT, "b")},
     t AS (SELECT vec_id, CAST(count(DISTINCT root) AS INTEGER) AS n FROM d GROUP BY vec_id),
     u AS (SELECT vec_id, CAST(count(DISTINCT root) AS INTEGER) AS n FROM b GROUP BY vec_id)
SELECT vec_id, coalesce(t.n, 0) AS total_objects, coalesce(u.n, 0) AS bright_sources,
       coalesce(t.n, 0) - coalesce(u.n, 0) AS faint_sources
FROM embeddings LEFT JOIN t USING (vec_id) LEFT JOIN u USING (vec_id)""")
def source_counts(spark, sf):
    return lab.source_counts(frames(spark, sf), "pixels", SIDE, DETECT, BRIGHT)


CATALOG_SQL = f"""
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) AS INTEGER) AS label,
       avg(x) AS x, avg(y) AS y, sum(sub) AS flux_total, max(sub) AS flux_peak,
       CAST(count(*) AS DOUBLE) AS area_pixels,
       -2.5 * log10(greatest(sum(sub), 1e-10)) + 25 AS magnitude_estimate,
       max(sub) / max(background_noise) AS snr
FROM b GROUP BY vec_id, root"""
MEASURES = ["x", "y", "flux_total", "flux_peak", "area_pixels", "magnitude_estimate", "snr"]
ROUNDED_MEASURES = ", ".join(f"{r(m)} AS {m}" for m in MEASURES)


@query("source_catalog", f"""
WITH RECURSIVE {labeled_sql(BRIGHT, "b")}, c AS ({CATALOG_SQL})
SELECT vec_id, label, {ROUNDED_MEASURES} FROM c""")
def source_catalog(spark, sf):
    out = lab.source_catalog(frames(spark, sf), ["vec_id"], "pixels", SIDE, BRIGHT)
    return rounded(out, *MEASURES)


@query("label_pixels_in_rounds", f"""
WITH RECURSIVE {labeled_sql(DETECT, "b")}
SELECT vec_id, count(*) AS pixels, CAST(sum(root) AS BIGINT) AS roots FROM b GROUP BY vec_id""")
def label_pixels_in_rounds(spark, sf):
    """Every graph of border parts is merged in rounds of joins."""
    mask = fr.sigma_mask(frames(spark, sf), ["vec_id"], "pixels", SIDE, DETECT)
    found = lab.label_pixels(mask.select("vec_id", "y", "x"), ["vec_id"], tile=2, max_group_rows=1)
    root = F.shiftright("source", 32) * SIDE + F.col("source") % (1 << 32)
    return found.groupBy("vec_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(root).alias("roots"))


@query("label_pixels", f"""
WITH RECURSIVE {labeled_sql(DETECT, "b")}, c AS ({CATALOG_SQL})
SELECT vec_id, label, {ROUNDED_MEASURES} FROM c""")
def label_pixels(spark, sf):
    """The pixel-row plan, with tiles smaller than the frames so that regions cross borders."""
    noise = fr.mad_noise(frames(spark, sf), "pixels").select("vec_id", "background_noise")
    mask = fr.sigma_mask(frames(spark, sf), ["vec_id"], "pixels", SIDE, DETECT)
    found = lab.measure_sources(
        lab.label_pixels(mask, ["vec_id"], tile=5), ["vec_id"], "above"
    )
    out = lab.with_photometry(found.join(noise, "vec_id"))
    out = lab.number_sources(out, ["vec_id"]).withColumn("label", F.col("label").cast("int"))
    return rounded(out.drop("background_noise", "source"), *MEASURES)


LISTED = 2


@query("source_lists", f"""
WITH RECURSIVE {labeled_sql(BRIGHT, "b")}, c AS ({CATALOG_SQL})
SELECT vec_id, CAST(count(place) AS INTEGER) AS listed, {r("coalesce(sum(x), 0)")} AS sum_x,
       {r("coalesce(sum(y), 0)")} AS sum_y, {r("coalesce(sum(flux_total), 0)")} AS sum_flux,
       {r("coalesce(sum(magnitude_estimate), 0)")} AS sum_magnitude, {r("coalesce(sum(snr), 0)")} AS sum_snr
FROM embeddings LEFT JOIN (SELECT * RENAME (label AS place) FROM c WHERE label <= {LISTED}) USING (vec_id) GROUP BY vec_id""")
def source_lists(spark, sf):
    found = lab.detect(frames(spark, sf), "pixels", SIDE, DETECT, BRIGHT)
    positions, photometry = lab.source_lists("sources", "background_noise", LISTED)
    lists = found.select("vec_id", positions.alias("positions"), photometry.alias("photometry"))
    total = lambda column, name: F.aggregate(
        column, F.lit(0.0), lambda acc, s: acc + s[name]
    )
    out = lists.select(
        "vec_id",
        F.size("positions").alias("listed"),
        total("positions", "x").alias("sum_x"),
        total("positions", "y").alias("sum_y"),
        total("photometry", "flux_total").alias("sum_flux"),
        total("photometry", "magnitude_estimate").alias("sum_magnitude"),
        total("photometry", "snr").alias("sum_snr"),
    )
    return rounded(out, *[c for c in out.columns if c.startswith("sum_")])


REPORT_SQL = f"""
WITH RECURSIVE {labeled_sql(DETECT, "d")}, {labeled_sql(BRIGHT, "b")},
t AS (SELECT vec_id, CAST(count(DISTINCT root) AS INTEGER) AS n FROM d GROUP BY vec_id),
u AS (SELECT vec_id, CAST(count(DISTINCT root) AS INTEGER) AS n FROM b GROUP BY vec_id),
q AS (SELECT vec_id, {FRAME_PATH} AS file_path, coalesce(t.n, 0) AS total_objects,
        coalesce(u.n, 0) AS bright_sources, coalesce(t.n, 0) - coalesce(u.n, 0) AS faint_sources,
        background_level, background_noise, dynamic_range, saturation_fraction,
        list_filter([CASE WHEN background_noise > 0 THEN
                       least((brightest - background_level) / background_noise / 100, 1) END,
                     1 - least(saturation_fraction * 10, 1), least(coalesce(t.n, 0) / 100.0, 1),
                     CASE WHEN dynamic_range > 0 THEN least(dynamic_range / 60000, 1) END],
                    lambda f: f IS NOT NULL) AS factors
      FROM embeddings JOIN {noise_sql(SATURATED)} USING (vec_id)
      LEFT JOIN t USING (vec_id) LEFT JOIN u USING (vec_id)),
report AS (SELECT *, list_sum(factors) / len(factors) AS quality_score FROM q)"""


@query("quality_score", f"""
{REPORT_SQL} SELECT file_path, {r("quality_score")} AS quality_score FROM report""")
def quality_score(spark, sf):
    return rounded(report(spark, sf).select("file_path", "quality_score"), "quality_score")


def report(spark, sf):
    return detection_report(
        named_frames(spark, sf), "path", "pixels", SIDE, detection_sigma=DETECT,
        bright_sigma=BRIGHT, saturation_level=SATURATED,
    )


REPORT_NUMBERS = [
    "background_level", "background_noise", "dynamic_range", "saturation_fraction", "quality_score"
]
REPORT_RUN = "nullif(regexp_extract(file_path, '[0-9]{10}'), '')"


DETECTION_SQL = f"""
{REPORT_SQL}
SELECT file_path, coalesce(left({REPORT_RUN}, 4), 'UNKNOWN') AS telescope_id,
       'UNKNOWN' AS observation_time,
       upper(replace(split_part(regexp_extract(file_path, '[^/]*$'), '_', 2), '.fits', '')) AS image_type,
       total_objects, bright_sources, faint_sources, {", ".join(f"{r(c)} AS {c}" for c in REPORT_NUMBERS)},
       bright_sources AS n_positions, bright_sources AS n_photometry, 'SUCCESS' AS processing_status
FROM report"""


@query("detection_report", DETECTION_SQL)
def detection_rows(spark, sf):
    out = report(spark, sf).withColumns(
        {"n_positions": F.size("source_positions"), "n_photometry": F.size("photometry_data")}
    )
    return rounded(out.drop("source_positions", "photometry_data"), *REPORT_NUMBERS)


LIGHT_SQL = f"""
(SELECT p.vec_id, max(m) AS mean_value, max(s) AS std_value,
        CAST(count(*) FILTER (WHERE v > m + 3 * s) AS INTEGER) AS num_objects
 FROM {PIXELS_SQL} p
 JOIN (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM {PIXELS_SQL} GROUP BY vec_id) t
 ON p.vec_id = t.vec_id GROUP BY p.vec_id)"""
LIGHT_COLUMNS = f"{r('mean_value')} AS mean_value, {r('std_value')} AS std_value, num_objects"


@query("light_stats", f"SELECT vec_id, {LIGHT_COLUMNS} FROM {LIGHT_SQL}")
def light_stats(spark, sf):
    return rounded(fr.light_stats(frames(spark, sf), "pixels"), "mean_value", "std_value")


SAMPLE, SEED, LOW_PRESSURE = 20, 7, 0.3


def md5_hash(*columns):
    """A pixel's place in the draw by a hash that DuckDB has too: the first 40 bits of an MD5."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *columns)), F.lit(10)), 16, 10).cast("bigint")


SAMPLED_SQL = f"""
(SELECT d.vec_id, max(m) AS mean_value, max(s) AS std_value,
        CAST(trunc(count(*) FILTER (WHERE v > m + 3 * s) * max(n) / least(max(n), {SAMPLE})) AS INTEGER) AS num_objects
 FROM (SELECT vec_id, v, count(*) OVER (PARTITION BY vec_id) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY
         CAST('0x' || md5(vec_id || ':' || (y * 8 + x) || ':{SEED}')[:10] AS BIGINT), y, x) AS place FROM {PIXELS_SQL}) d
 JOIN (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM (
         SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY
           CAST('0x' || md5(vec_id || ':' || (y * 8 + x) || ':{SEED}')[:10] AS BIGINT), y, x) AS place FROM {PIXELS_SQL})
       WHERE place <= {SAMPLE} GROUP BY vec_id) t ON d.vec_id = t.vec_id
 WHERE place <= {SAMPLE} GROUP BY d.vec_id)"""
SAMPLED_STATS_SQL = f"SELECT vec_id, {LIGHT_COLUMNS} FROM {SAMPLED_SQL}"


@query("sampled_stats", SAMPLED_STATS_SQL)
def sampled_stats(spark, sf):
    """Statistics of 20 of 64 pixels; the twin draws the same ones."""
    out = fr.sampled_stats(frames(spark, sf), "pixels", ["vec_id"], SAMPLE, SEED, md5_hash)
    return rounded(out, "mean_value", "std_value")


@query("light_or_sampled", f"""
SELECT vec_id, {LIGHT_COLUMNS}, mode FROM (
  SELECT *, 'light' AS mode FROM {LIGHT_SQL} WHERE vec_id % 2 = 0
  UNION ALL SELECT *, 'sampled' FROM {SAMPLED_SQL} WHERE vec_id % 2 = 1)""")
def light_or_sampled(spark, sf):
    """Whole images for even ids, whose pressure is low; odd ones are sampled."""
    pressure = F.when(F.col("vec_id") % 2 == 0, 0.1).otherwise(0.9)
    out = fr.light_or_sampled(frames(spark, sf), "pixels", ["vec_id"], pressure, SAMPLE, LOW_PRESSURE, SEED, md5_hash)
    return rounded(out, "mean_value", "std_value")


@query("decode_frames", f"""
SELECT {FRAME_PATH} AS frame_id, 8 AS height, 8 AS width, CAST(len(embedding) AS INTEGER) AS n_pixels,
       {r("list_sum(embedding::DOUBLE[])")} AS total, CAST(embedding[10] AS DOUBLE) AS tenth,
       'SUCCESS' AS status FROM embeddings""")
def decoded(spark, sf):
    out = decode_frames(image_files(spark, sf)).select(
        "frame_id", "height", "width", F.size("pixels").alias("n_pixels"),
        F.aggregate(F.col("pixels").cast("array<double>"), F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.get("pixels", 9).cast("double").alias("tenth"), "status",
    )
    return rounded(out, "total")


CUTOUTS_SQL = """
(SELECT CASE WHEN vec_id % 35 > 0 THEN vec_id + 1 END AS candid, kind,
        CASE WHEN vec_id % 35 > 0 THEN CAST(vec_id + 1 AS VARCHAR) ELSE 'hash' END || '_' || kind || '.fits' AS file_name, vec_id
 FROM embeddings, (VALUES ('science'), ('template'), ('difference')) k(kind)
 WHERE NOT (kind = 'template' AND vec_id % 7 = 0) AND NOT (kind = 'difference' AND vec_id % 11 = 0))"""


def without_hashes(cutouts):
    """Ids that are hashes of the stamps as nulls, and so in the names."""
    return cutouts.withColumns({
        "candid": F.when(F.col("candid") >= 0, F.col("candid")),
        "file_name": F.regexp_replace("file_name", "^-[0-9]+", "hash"),
    })


@query("explode_cutouts", f"SELECT candid, kind, file_name FROM {CUTOUTS_SQL}")
def cutouts(spark, sf):
    return without_hashes(explode_cutouts(alerts(spark, sf))).drop("content")


@query("inflate_stamps", f"""
SELECT file_name, 5760 AS n_bytes, {r("median_bg")} AS median_bg
FROM {CUTOUTS_SQL} JOIN {FRAME_STATS_SQL} USING (vec_id)""")
def inflated(spark, sf):
    raw = inflate_stamps(without_hashes(explode_cutouts(alerts(spark, sf))))
    # The size travels in the id, so that one pass inflates, measures and decodes.
    named = raw.select(F.concat_ws("|", "file_name", F.octet_length("content")).alias("file_name"), "content")
    levels = fr.frame_median(decode_frames(named, "file_name"), "pixels")
    out = levels.select(
        F.split_part("frame_id", F.lit("|"), F.lit(1)).alias("file_name"),
        F.split_part("frame_id", F.lit("|"), F.lit(2)).cast("int").alias("n_bytes"), "median_bg",
    )
    return rounded(out, "median_bg")


@query("partition_function", f"""
SELECT {FRAME_PATH} AS path, 5760 AS n_bytes, 'SIMPLE' AS first_word FROM embeddings""")
def partition_function(spark, sf):
    def describe(pairs):
        for path, data in pairs:
            yield path, len(data), data[:8].decode().strip()

    wanted = schemas.struct(path=schemas.STRING, n_bytes=schemas.INT, first_word=schemas.STRING)
    return map_files(image_files(spark, sf), describe, wanted)
