"""Round trips through sources and sinks. Outputs go to new folders in the shared workspace."""

from pyspark.sql import functions as F

from framelake import schemas
from framelake.functions.measures import ratio_or_zero
from framelake.operators.frames import frame_stats
from framelake.registry.base import query, rounded, sql_round as r, table
from framelake.registry.derived import FRAME_PATH, FRAME_STATS_SQL, alerts, image_files
from framelake.registry.images import CUTOUTS_SQL, without_hashes
from framelake.sources import sinks, tables
from framelake.sources.images import decode_frames, explode_cutouts
from framelake.workspace import new_folder


def written_images(spark, sf) -> str:
    """One image file per frame, written by Spark."""
    path = new_folder(spark, "images")
    files = image_files(spark, sf).withColumn("name", F.substring_index("path", "/", -1))
    return sinks.sink_image_files(files, path, "name")


@query("scan_binary", f"""
SELECT regexp_extract(path, '[^/]*$') AS file_name, {r("median_bg")} AS median_bg, bright_pixels
FROM (SELECT vec_id, {FRAME_PATH} AS path FROM embeddings) JOIN {FRAME_STATS_SQL} USING (vec_id)""")
def scan_binary(spark, sf):
    files = tables.scan_binary(spark, written_images(spark, sf), recursive=True)
    stats = frame_stats(
        decode_frames(sinks.named_image_files(files)).drop("height", "width", "status"), "pixels"
    )
    out = stats.select(
        F.substring_index("frame_id", "/", -1).alias("file_name"), "median_bg", "bright_pixels"
    )
    return rounded(out, "median_bg")


@query("scan_listing", f"""
SELECT regexp_extract({FRAME_PATH}, '[^/]*$') AS file_name, CAST(5761 AS BIGINT) AS length FROM embeddings""")
def scan_listing(spark, sf):
    files = tables.scan_listing(spark, written_images(spark, sf), recursive=True)
    return sinks.named_image_files(files).select(
        F.substring_index("path", "/", -1).alias("file_name"), "length"
    )


@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def scan_parquet(spark, sf):
    wanted = schemas.struct(o_orderkey=schemas.BIGINT, o_totalprice=schemas.DOUBLE)
    return tables.scan_parquet(spark, f"{sf}/orders.parquet", wanted)


@query("scan_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv(spark, sf):
    wanted = schemas.struct(
        c_custkey=schemas.BIGINT, c_name=schemas.STRING, c_acctbal=schemas.DOUBLE
    )
    rows = table(spark, sf, "customer").select(*wanted.fieldNames())
    return tables.scan_csv(spark, sinks.sink_csv(rows, new_folder(spark, "csv")), wanted)


@query("scan_text", "SELECT p_partkey || ',' || p_name AS value FROM part")
def scan_text(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return tables.scan_text(spark, sinks.sink_text_rows(rows, new_folder(spark, "text")))


@query("scan_alerts", """
SELECT CASE WHEN vec_id % 5 = 0 THEN 0 WHEN vec_id % 5 <> 1 THEN vec_id + 1 END AS candid,
       CASE WHEN vec_id % 35 = 0 THEN 0 ELSE vec_id + 1 END AS alert_id, true AS has_science, vec_id % 7 <> 0 AS has_template,
       vec_id % 11 <> 0 AS has_difference FROM embeddings""")
def scan_alerts(spark, sf):
    path = sinks.sink_parquet(alerts(spark, sf), new_folder(spark, "alerts"))
    has = lambda kind: F.coalesce(F.octet_length(f"cutout{kind}.stampData") > 0, F.lit(False))
    return tables.scan_alerts(spark, path).select(
        "candid", F.col("alertId").alias("alert_id"), has("Science").alias("has_science"),
        has("Template").alias("has_template"), has("Difference").alias("has_difference"),
    )


@query("rows_from_memory", """
SELECT o_orderkey, label FROM orders
JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial')) l(status, label) ON o_orderstatus = status""")
def rows_from_memory(spark, sf):
    labels = tables.rows_from_memory(
        spark, [("F", "finished"), ("O", "open"), ("P", "partial")], "o_orderstatus string, label string"
    )
    # Three rows by construction.
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(F.broadcast(labels), "o_orderstatus").select("o_orderkey", "label")


@query("sink_parquet", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_parquet(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return tables.scan_parquet(spark, sinks.sink_parquet(rows, new_folder(spark, "parquet"), files=2))


@query("sink_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def sink_csv(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    path = sinks.sink_csv(rows, new_folder(spark, "csv"))
    wanted = schemas.struct(c_custkey=schemas.STRING, c_mktsegment=schemas.STRING)
    return tables.scan_csv(spark, path, wanted)


@query("sink_text_rows", """
SELECT p_partkey || ',' || coalesce(CASE WHEN p_size > 10 THEN p_name END, 'None') || ','
       || printf('%.4f', p_retailprice) AS value FROM part""")
def sink_text_rows(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"), "p_retailprice"
    )
    path = sinks.sink_text_rows(rows, new_folder(spark, "text"), formats={"p_retailprice": "%.4f"})
    return tables.scan_text(spark, path)


@query("sink_json_report", f"""
SELECT '20251012_153354' AS timestamp, count(*) AS total_files,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS successful_files,
       {r("count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)")} AS success_rate FROM orders""")
def sink_json_report(spark, sf):
    good = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    everything = F.count(F.lit(1))
    report = table(spark, sf, "orders").agg(
        F.lit("20251012_153354").alias("timestamp"),
        F.struct(
            everything.alias("total_files"), good.alias("successful_files"),
            ratio_or_zero(good, everything).alias("success_rate"),
        ).alias("summary"),
    )
    path = sinks.sink_json_report(report, new_folder(spark, "report"))
    back = spark.read.schema(report.schema).json(path)
    return rounded(back.select("timestamp", "summary.*"), "success_rate")


@query("sink_publish_run", "SELECT o_orderkey, o_orderpriority FROM orders")
def sink_publish_run(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    target = sinks.tagged_path(new_folder(spark, "published"), "full_20251012_153354")
    sinks.sink_publish_run(rows.filter("o_orderkey % 2 = 0"), target)  # an earlier run, to be replaced
    return tables.scan_parquet(spark, sinks.sink_publish_run(rows, target))


@query("publish_run", "SELECT o_orderkey, o_orderpriority, CAST(2 AS BIGINT) AS runs FROM orders")
def publish_run(spark, sf):
    """Two runs published one after the other; the pointer leads to the second."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    base = new_folder(spark, "published")
    sinks.publish_run(rows.filter("o_orderkey % 2 = 0"), base, "half_20251012_153354")
    sinks.publish_run(rows, base, "full_20251012_153354")
    runs = sinks.published_runs(spark, base).agg(F.count(F.lit(1)).alias("runs"))
    current = tables.scan_parquet(spark, sinks.current_run(spark, base))
    return current.withColumn("runs", runs.scalar())


@query("run_tag", "SELECT s_suppkey, 'full_20251012_153354' AS run_id FROM supplier")
def run_tag(spark, sf):
    return sinks.run_tag(table(spark, sf, "supplier").select("s_suppkey"), "full_20251012_153354")


@query("sink_cutouts", f"SELECT candid, kind, file_name, true AS is_gzip FROM {CUTOUTS_SQL}")
def sink_cutouts(spark, sf):
    path = sinks.sink_cutouts(explode_cutouts(alerts(spark, sf)), new_folder(spark, "cutouts"))
    rows = without_hashes(tables.scan_parquet(spark, path, schemas.CUTOUTS))
    return rows.select(
        "candid", "kind", "file_name",
        (F.hex(F.substring("content", 1, 2)) == "1F8B").alias("is_gzip"),
    )
