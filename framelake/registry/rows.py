"""Projection, filtering, ordering, set operators."""

from pyspark.sql import functions as F

from framelake import schemas
from framelake.functions.measures import object_density, signal_to_noise, table_quality
from framelake.operators import relational as rel
from framelake.registry.base import query, rounded, sql_round as r, table


@query("project_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def project_columns(spark, sf):
    return rel.project_columns(table(spark, sf, "part"), ["p_partkey", "p_brand", "p_size"])


@query("drop_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def drop_columns(spark, sf):
    return rel.drop_columns(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query("filter_equals",
       "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_equals(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return rel.filter_equals(orders, "o_orderstatus", "F")


@query("filter_range", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity >= 10 AND l_quantity < 20""")
def filter_range(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rel.filter_range(rows, "l_quantity", 10.0, 20.0)


SCORES_SQL = """
(SELECT event_id, event_type,
        CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN NULL
             ELSE value END AS score FROM events)"""


def scores(spark, sf):
    """Event values with NaN and null put in."""
    key = F.col("event_id")
    score = F.when(key % 7 == 0, float("nan")).when(key % 11 == 0, None).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", "event_type", score.alias("score"))


@query("filter_missing_or_nan", f"""
SELECT event_id, score IS NULL AS is_null FROM {SCORES_SQL}
WHERE event_type = 'click' AND (isnan(score) OR score IS NULL)""")
def filter_missing_or_nan(spark, sf):
    rows = rel.filter_missing_or_nan(
        rel.filter_equals(scores(spark, sf), "event_type", "click"), "score"
    )
    return rows.select("event_id", F.col("score").isNull().alias("is_null"))


@query("filter_valid", f"""
SELECT event_id, score FROM {SCORES_SQL}
WHERE event_type = 'click' AND NOT isnan(score) AND score IS NOT NULL""")
def filter_valid(spark, sf):
    rows = rel.filter_equals(scores(spark, sf), "event_type", "click")
    return rel.filter_valid(rows, "score").select("event_id", "score")


HEADER = "custkey,name,nationkey"
LINE = f"""
CASE WHEN c_custkey % 13 = 0 THEN '{HEADER}' WHEN c_custkey % 10 = 0 THEN '   '
     WHEN c_custkey % 7 = 1 THEN chr(9) WHEN c_custkey % 11 = 1 THEN chr(13)
     WHEN c_custkey % 9 = 0 THEN CAST(c_custkey AS STRING) || ',' || c_name || ',n/a'
     ELSE CAST(c_custkey AS STRING) || ',' || c_name || ',' || CAST(c_nationkey AS STRING) END"""
LINES_SQL = f"""
(SELECT line FROM (SELECT {LINE} AS line FROM customer)
 WHERE line <> '{HEADER}' AND NOT regexp_full_match(line, '\\s*'))"""


def data_lines(spark, sf):
    lines = table(spark, sf, "customer").select(F.expr(LINE).alias("line"))
    return rel.filter_blank_and_header(lines, "line", HEADER)


@query("filter_blank_and_header", f"SELECT line FROM {LINES_SQL}")
def filter_blank_and_header(spark, sf):
    return data_lines(spark, sf)


@query("text_job", f"""
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN '{HEADER}' ELSE {LINE} END AS line
           FROM customer),
     h AS (SELECT arg_min(line, c_custkey) AS header FROM l)
SELECT header, count(*) AS data_lines, count(TRY_CAST(split_part(line, ',', 3) AS BIGINT)) AS with_nation,
       CAST(sum(TRY_CAST(split_part(line, ',', 1) AS BIGINT)) AS BIGINT) AS keys
FROM l, h WHERE line <> header AND NOT regexp_full_match(line, '\\s*') GROUP BY header""")
def text_job(spark, sf):
    """Header from the first line, blank and repeated header lines dropped, fields, one summary line."""
    customers = table(spark, sf, "customer")
    first = customers.agg(F.min("c_custkey")).scalar()
    lines = customers.select(
        "c_custkey", F.when(F.col("c_custkey") == first, HEADER).otherwise(F.expr(LINE)).alias("line")
    )
    rows, header = rel.split_header(lines, "line", "c_custkey")
    fields = rel.split_fields(rows, "line", header.split(","), ints=["custkey", "nationkey"])
    return fields.agg(
        F.lit(header).alias("header"), F.count(F.lit(1)).alias("data_lines"),
        F.count("nationkey").alias("with_nation"), F.sum("custkey").alias("keys"),
    )


@query("split_fields", f"""
SELECT split_part(line, ',', 1) AS custkey, split_part(line, ',', 2) AS name,
       TRY_CAST(split_part(line, ',', 3) AS BIGINT) AS nationkey FROM {LINES_SQL}""")
def split_fields(spark, sf):
    return rel.split_fields(
        data_lines(spark, sf), "line", ["custkey", "name", "nationkey"], ints=["nationkey"]
    )


@query("drop_incomplete", """
SELECT o_custkey, f_total, o_total FROM (
  SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f_total,
         CASE WHEN o_custkey % 5 = 0 THEN 'NaN'::DOUBLE
              ELSE max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') END AS o_total
  FROM orders GROUP BY o_custkey)
WHERE f_total IS NOT NULL AND o_total IS NOT NULL AND NOT isnan(o_total)""")
def drop_incomplete(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("f_total"),
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("o_total"),
    )
    wide = wide.withColumn(
        "o_total", F.when(F.col("o_custkey") % 5 == 0, float("nan")).otherwise(F.col("o_total"))
    )
    return rel.drop_incomplete(wide)


SUPPLIER_CATALOG_SQL = """
SELECT s_name AS file_path, 'S' AS telescope, CAST(NULL AS VARCHAR) AS data_type,
       CAST(NULL AS VARCHAR) AS observation_date, CAST(s_nationkey AS INTEGER) AS field_id,
       CAST(NULL AS INTEGER) AS detector_id, CAST(NULL AS VARCHAR) AS filter_band,
       s_suppkey AS exposure_id, CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE) AS file_size_mb,
       CAST(NULL AS VARCHAR) AS processing_timestamp, CAST(NULL AS VARCHAR) AS quality_flags
FROM supplier"""


def supplier_source(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("file_path"), F.lit("S").alias("telescope"),
        F.col("s_nationkey").cast("bigint").alias("field_id"),
        F.col("s_suppkey").alias("exposure_id"), F.col("s_acctbal").alias("file_size_mb"),
    )


def customer_source(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("data_type"), F.col("c_name").alias("file_path"),
        F.lit("C").alias("telescope"), F.col("c_custkey").alias("exposure_id"),
    )


def widened(df):
    """Floats as doubles, which both engines print alike."""
    return df.withColumn("file_size_mb", F.col("file_size_mb").cast("double"))


@query("conform_to_schema", SUPPLIER_CATALOG_SQL)
def conform_to_schema(spark, sf):
    return widened(rel.conform_to_schema(supplier_source(spark, sf), schemas.CATALOG))


@query("union_catalog", SUPPLIER_CATALOG_SQL + """
UNION ALL
SELECT c_name, 'C', c_mktsegment, NULL, NULL, NULL, NULL, c_custkey, NULL, NULL, NULL FROM customer""")
def union_catalog(spark, sf):
    sources = [supplier_source(spark, sf), customer_source(spark, sf)]
    return widened(rel.union_catalog(sources, schemas.CATALOG))


@query("apply_schema", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
       o_orderstatus, CAST(NULL AS VARCHAR) AS note FROM orders""")
def apply_schema(spark, sf):
    wanted = schemas.struct(
        o_orderkey=schemas.STRING, o_custkey=schemas.INT, o_orderstatus=schemas.STRING,
        note=schemas.STRING,
    )
    return rel.apply_schema(table(spark, sf, "orders"), wanted)


@query("case_flag", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 5 THEN 1 ELSE 0 END AS is_small
FROM lineitem""")
def case_flag(spark, sf):
    rows = rel.case_flag(table(spark, sf, "lineitem"), F.col("l_quantity") <= 5, "is_small")
    return rows.select("l_orderkey", "l_linenumber", "is_small")


@query("null_flags", f"""
SELECT event_id, event_type IS NULL AS missing_event_type, score IS NULL AS missing_score
FROM {SCORES_SQL}""")
def null_flags(spark, sf):
    return rel.null_flags(scores(spark, sf), keep=["event_id"])


ORDER_STATS_SQL = """
(SELECT l_orderkey, avg(l_extendedprice) AS mean_value, coalesce(stddev_pop(l_quantity), 0) AS std_value,
        max(l_extendedprice) AS max_value,
        CAST(count(*) FILTER (WHERE l_quantity > 40) AS INTEGER) AS bright_objects
 FROM lineitem GROUP BY l_orderkey)"""


def order_stats(spark, sf):
    """One statistics row per order, in the shape of an image statistics table."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_extendedprice").alias("mean_value"),
        F.stddev_pop("l_quantity").alias("std_value"),
        F.max("l_extendedprice").alias("max_value"),
        F.count(F.when(F.col("l_quantity") > 40, 1)).cast("int").alias("bright_objects"),
    )


@query("snr_density_score", f"""
SELECT l_orderkey, {r("CASE WHEN std_value > 0 THEN mean_value / std_value ELSE 0 END", 8)} AS snr,
       {r("bright_objects / 10000.0")} AS object_density,
       {r("least(100, mean_value / 1000 / 10 + bright_objects * 5 - std_value / 50)", 9)} AS quality_score
FROM {ORDER_STATS_SQL}""")
def snr_density_score(spark, sf):
    rows = order_stats(spark, sf).select(
        "l_orderkey",
        F.round(signal_to_noise("mean_value", "std_value"), 8).alias("snr"),
        object_density("bright_objects").alias("object_density"),
        table_quality(F.col("mean_value") / 1000, "std_value", "bright_objects").alias("quality_score"),
    )
    return rounded(rows, "object_density", "quality_score", digits=9)


@query("partition_layout", """
SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM orders GROUP BY o_custkey""")
def partition_layout(spark, sf):
    # Laid out by the grouping key, so the aggregate needs no second shuffle.
    laid_out = rel.partition_layout(
        table(spark, sf, "orders").select("o_custkey", "o_orderkey"), keys=["o_custkey"]
    )
    return laid_out.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    )


@query("sort_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def sort_by(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rel.sort_by(rows, "c_acctbal", "c_custkey")


@query("limit_sample", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5""")
def limit_sample(spark, sf):
    rows = rel.filter_equals(table(spark, sf, "orders"), "o_orderstatus", "F")
    return rel.limit_sample(rows.select("o_orderkey", "o_totalprice"), 5, "o_orderkey")


@query("first_row", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 1")
def first_row(spark, sf):
    return rel.first_row(table(spark, sf, "events"), "ts", "event_id").select(
        "event_id", "event_type"
    )
