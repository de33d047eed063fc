"""String, date, JSON and arithmetic functions."""

from pyspark.sql import functions as F

from framelake.functions import measures, naming
from framelake.functions.pattern_index import classify_by_index
from framelake.registry.base import query, rounded, sql_round as r, table
from framelake.registry.derived import PATHS_SQL, paths
from framelake.registry.rows import SCORES_SQL, scores
from framelake.sources.specs import HSC, HSC_DETECTORS, HSC_VISITS, ZTF, extract_metadata

BASE = "regexp_extract(path, '[^/]*$')"
RUN10 = "nullif(regexp_extract(path, '[0-9]{10}'), '')"
RUN6 = "nullif(regexp_extract(path, '[0-9]{6}'), '')"
CCD = f"CAST(substr({RUN6}, 4, 2) AS INTEGER)"
BAND = f"CASE WHEN {CCD} <> 0 THEN list_extract(['g', 'r', 'i'], {CCD} % 3 + 1) END"
DATE = f"'20' || substr({RUN10}, 1, 2) || '-' || substr({RUN10}, 3, 2) || '-' || substr({RUN10}, 5, 2)"
TIME = (
    f"'2025-' || substr({RUN10}, 3, 2) || '-' || substr({RUN10}, 5, 2) || 'T' || "
    f"substr({RUN10}, 7, 2) || ':' || substr({RUN10}, 9, 2) || ':00'"
)
CLASS = f"""
CASE WHEN regexp_matches({BASE}, '_science\\.fits$') THEN 'SCIENCE'
     WHEN regexp_matches({BASE}, '_difference\\.fits$') THEN 'DIFFERENCE'
     WHEN regexp_matches({BASE}, '_template\\.fits$') THEN 'TEMPLATE' ELSE 'UNKNOWN' END"""
HSC_CLASS = f"""
CASE WHEN regexp_matches({BASE}, 'HSCA.*\\.fits$') THEN 'CALIBRATED'
     WHEN regexp_matches({BASE}, 'HSCR.*\\.fits$') THEN 'RAW' ELSE 'UNKNOWN' END"""


def bucket_sql(buckets: int, column: str = "path") -> str:
    return f"CAST(CAST('0x' || left(md5({column}), 8) AS BIGINT) % {buckets} AS INTEGER)"


def on_paths(spark, sf, **columns):
    return paths(spark, sf).select("o_orderkey", *[c.alias(n) for n, c in columns.items()])


@query("file_name_parts", f"""
SELECT o_orderkey, {BASE} AS file_name,
       split_part(replace({BASE}, '.fits', ''), '_', 1) AS object_id,
       coalesce(upper(nullif(split_part(replace({BASE}, '.fits', ''), '_', 2), '')), 'UNKNOWN') AS image_type
FROM {PATHS_SQL}""")
def file_name_parts(spark, sf):
    return on_paths(
        spark, sf, file_name=naming.base_name("path"), object_id=naming.object_id("path"),
        image_type=naming.image_type("path"),
    )


@query("type_from_substring", f"""
SELECT o_orderkey, CASE WHEN contains(path, 'difference') THEN 'DIFFERENCE'
  WHEN contains(path, 'science') THEN 'SCIENCE' WHEN contains(path, 'template') THEN 'TEMPLATE'
  ELSE 'UNKNOWN' END AS image_type FROM {PATHS_SQL}""")
def type_from_substring(spark, sf):
    return on_paths(spark, sf, image_type=naming.type_from_substring("path"))


URL_PATTERNS = [("QUERY", r"\?.*="), ("ANCHOR", r"#[a-z]+$"), ("NUMBERED", r"^[0-9]+")]


@query("classify_by_patterns", """
SELECT page_id, CASE WHEN regexp_matches(name, '\\?.*=') THEN 'QUERY'
  WHEN regexp_matches(name, '#[a-z]+$') THEN 'ANCHOR'
  WHEN regexp_matches(name, '^[0-9]+') THEN 'NUMBERED' ELSE 'UNKNOWN' END AS data_type
FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages)""")
def classify_by_patterns(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", naming.classify_by_patterns("url", URL_PATTERNS).alias("data_type")
    )


# Two thousand rules: a name's leading digits by their number, then its last word; the first in order wins.
INDEX_RULES = 1000


@query("classify_by_index", f"""
SELECT o_orderkey, CASE WHEN regexp_matches(name, '_(science|difference)\\.fits$') AND regexp_matches(name, '^[0-9]{{10}}_')
         THEN 'PAIR' || CAST(CAST(name[8:10] AS INTEGER) AS VARCHAR)
       WHEN regexp_matches(name, '_template\\.fits$') THEN 'T' || CAST(CAST(name[8:10] AS INTEGER) AS VARCHAR)
       ELSE 'UNKNOWN' END AS data_type
FROM (SELECT o_orderkey, regexp_extract(path, '[^/]*$') AS name FROM {PATHS_SQL})""")
def classify_by_many_patterns(spark, sf):
    rules = [rule for i in range(INDEX_RULES) for rule in (
        (f"PAIR{i}", rf"^[0-9]{{7}}{i:03d}_(science|difference)\.fits$"), (f"T{i}", rf"{i:03d}_template\.fits$"))]
    return on_paths(spark, sf, data_type=classify_by_index("path", rules))


@query("extract_metadata", f"""
SELECT o_orderkey, 'ZTF' AS telescope, {CLASS} AS data_type,
       CAST(substr({RUN6}, 1, 3) AS INTEGER) AS field_id, {CCD} AS ccd_id, {BAND} AS filter_band,
       {DATE} AS observation_date, CAST({RUN10} AS BIGINT) AS exposure_id FROM {PATHS_SQL}""")
def metadata(spark, sf):
    return extract_metadata(paths(spark, sf), "path", ZTF).drop("path")


@query("telescope_id", f"""
SELECT o_orderkey, coalesce(left({RUN10}, 4), 'UNKNOWN') AS telescope_id FROM {PATHS_SQL}""")
def telescope_id(spark, sf):
    return on_paths(spark, sf, telescope_id=naming.telescope_id("path"))


@query("observation_time", f"""
SELECT o_orderkey, coalesce({TIME}, 'UNKNOWN') AS observation_time,
       try_strptime({TIME}, '%Y-%m-%dT%H:%M:%S') IS NOT NULL AS is_calendar_time FROM {PATHS_SQL}""")
def observation_time(spark, sf):
    return on_paths(
        spark, sf, observation_time=naming.observation_time("path"),
        is_calendar_time=naming.observation_timestamp("path").isNotNull(),
    )


@query("field_and_ccd", f"""
SELECT o_orderkey, CAST(substr({RUN6}, 1, 3) AS INTEGER) AS field_id, {CCD} AS ccd_id FROM {PATHS_SQL}""")
def field_and_ccd(spark, sf):
    return on_paths(spark, sf, field_id=naming.field_id("path"), ccd_id=naming.ccd_id("path"))


@query("filter_band", f"SELECT o_orderkey, {BAND} AS filter_band FROM {PATHS_SQL}")
def filter_band(spark, sf):
    return on_paths(spark, sf, filter_band=naming.filter_band(naming.ccd_id("path")))


@query("observation_date", f"SELECT o_orderkey, {DATE} AS observation_date FROM {PATHS_SQL}")
def observation_date(spark, sf):
    return on_paths(spark, sf, observation_date=naming.observation_date("path"))


@query("exposure_id", f"SELECT o_orderkey, CAST({RUN10} AS BIGINT) AS exposure_id FROM {PATHS_SQL}")
def exposure_id(spark, sf):
    return on_paths(spark, sf, exposure_id=naming.exposure_id("path"))


@query("stable_bucket", f"""
SELECT o_orderkey, {bucket_sql(HSC_VISITS)} AS visit_id, {bucket_sql(HSC_DETECTORS)} AS detector_id
FROM {PATHS_SQL}""")
def stable_bucket(spark, sf):
    return on_paths(
        spark, sf, visit_id=naming.stable_bucket("path", HSC_VISITS),
        detector_id=naming.stable_bucket("path", HSC_DETECTORS),
    )


@query("extractor_registry", f"""
SELECT o_orderkey, 'HSC' AS telescope, {HSC_CLASS} AS data_type, {bucket_sql(HSC_VISITS)} AS visit_id,
       {bucket_sql(HSC_DETECTORS)} AS detector_id, CAST(length({BASE}) AS INTEGER) AS name_length
FROM {PATHS_SQL}""")
def extractor_registry(spark, sf):
    spec = HSC.with_extractor("name_length", lambda path: F.length(naming.base_name(path)))
    return extract_metadata(paths(spark, sf), "path", spec).drop("path")


@query("image_size_mb", f"SELECT doc_id, {r('n_chars / 1048576.0', 9)} AS size_mb FROM documents")
def image_size_mb(spark, sf):
    return rounded(
        table(spark, sf, "documents").select("doc_id", measures.size_mb("n_chars").alias("size_mb")),
        "size_mb", digits=9,
    )


@query("processing_time", """
SELECT o_orderkey, '2025-10-12T15:33:54' AS processing_timestamp,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS order_timestamp FROM orders""")
def processing_time(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.lit("2025-10-12T15:33:54").alias("processing_timestamp"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("order_timestamp"),
    )


@query("json_encode", """
SELECT event_id, '[{"kind":"' || event_type || '","user":' || user_id || '}]' AS encoded,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_encode(spark, sf):
    nested = F.array(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return table(spark, sf, "events").select(
        "event_id", F.to_json(nested).alias("encoded"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


@query("status_text", """
SELECT p_partkey, 'ERR:' || left(p_name || ' ' || p_type || ' ' || p_brand, 20) AS status FROM part""")
def status_text(spark, sf):
    message = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return table(spark, sf, "part").select(
        "p_partkey", measures.status_text("ERR:", message, 20).alias("status")
    )


@query("percent_of", f"""
SELECT o_orderkey, coalesce({r("100.0 * o_custkey / nullif(o_orderkey % 10, 0)")}, 0) AS percent FROM orders""")
def percent_of(spark, sf):
    out = table(spark, sf, "orders").select(
        "o_orderkey", measures.percent_of("o_custkey", F.col("o_orderkey") % 10).alias("percent")
    )
    return rounded(out, "percent")


@query("magnitude", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
       {r("-2.5 * log10(greatest(l_extendedprice * l_discount, 1e-10)) + 25")} AS magnitude FROM lineitem""")
def magnitude(spark, sf):
    out = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        measures.magnitude(F.col("l_extendedprice") * F.col("l_discount")).alias("magnitude"),
    )
    return rounded(out, "magnitude")


@query("mask_non_finite", f"""
SELECT event_id, CASE WHEN isfinite(score) AND event_id % 5 > 0 THEN score END AS masked FROM {SCORES_SQL}""")
def mask_non_finite(spark, sf):
    endless = F.when(F.col("event_id") % 5 == 0, float("-inf")).otherwise(F.col("score"))
    return scores(spark, sf).select("event_id", measures.mask_non_finite(endless).alias("masked"))


@query("row_function", f"""
SELECT o_orderkey, coalesce(left({RUN10}, 4), 'UNKNOWN') || ':' || {CLASS} AS tag FROM {PATHS_SQL}""")
def row_function(spark, sf):
    # What was a function called per row is one column expression.
    tag = F.concat_ws(
        ":", naming.telescope_id("path"), naming.classify_by_patterns("path", ZTF.patterns)
    )
    return on_paths(spark, sf, tag=tag)
