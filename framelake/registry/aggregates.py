"""Aggregations."""

from pyspark.sql import Window, functions as F

from framelake.operators import aggregates as agg
from framelake.operators.skew import long_frame_stats
from framelake.registry.base import query, rounded, sql_round as r, table
from framelake.registry.rows import ORDER_STATS_SQL, SCORES_SQL, order_stats, scores
from framelake.sources.sinks import sink_buckets
from framelake.workspace import new_folder


@query("global_count", "SELECT count(*) AS n FROM orders")
def global_count(spark, sf):
    return agg.global_count(table(spark, sf, "orders"))


@query("numeric_summary", f"""
SELECT count(c_acctbal) AS n, {r("sum(c_acctbal)", 2)} AS total, {r("avg(c_acctbal)")} AS mean,
       min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer""")
def numeric_summary(spark, sf):
    out = agg.numeric_summary(table(spark, sf, "customer"), "c_acctbal")
    return rounded(rounded(out, "total", digits=2), "mean")


PROFILE_SQL = f"""
count(*) AS total_files, {r("avg(mean_value)", 4)} AS avg_background, {r("avg(std_value)")} AS avg_noise,
max(max_value) AS brightest_pixel, CAST(sum(bright_objects) AS BIGINT) AS total_bright_objects,
{r("avg(bright_objects)")} AS avg_objects_per_image"""
DERIVED_SQL = f"""
{r("avg(CASE WHEN std_value > 0 THEN mean_value / std_value ELSE 0 END)", 4)} AS avg_snr,
{r("avg(bright_objects / 10000.0)")} AS avg_object_density,
{r("avg(least(100, mean_value / 10 + bright_objects * 5 - std_value / 50))")} AS avg_quality_score"""


@query("global_profile", f"SELECT {PROFILE_SQL} FROM {ORDER_STATS_SQL}")
def global_profile(spark, sf):
    out = agg.global_profile(
        order_stats(spark, sf), "mean_value", "std_value", "max_value", "bright_objects"
    )
    return rounded(rounded(out, "avg_noise", "avg_objects_per_image"), "avg_background", digits=4)


@query("mean_of_derived", f"SELECT {DERIVED_SQL} FROM {ORDER_STATS_SQL}")
def mean_of_derived(spark, sf):
    out = agg.mean_of_derived(order_stats(spark, sf), "mean_value", "std_value", "bright_objects")
    return rounded(rounded(out, "avg_object_density", "avg_quality_score"), "avg_snr", digits=4)


@query("synthetic_table_profile", f"SELECT {PROFILE_SQL}, {DERIVED_SQL} FROM {ORDER_STATS_SQL}")
def synthetic_table_profile(spark, sf):
    out = agg.synthetic_table_profile(
        order_stats(spark, sf), "mean_value", "std_value", "max_value", "bright_objects"
    )
    out = rounded(out, "avg_background", "avg_snr", digits=4)
    return rounded(
        out, "avg_noise", "avg_objects_per_image", "avg_object_density", "avg_quality_score"
    )


@query("group_count",
       "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY 1")
def group_count(spark, sf):
    return agg.group_count(table(spark, sf, "orders"), "o_orderstatus")


@query("group_count_multi", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL""")
def group_count_multi(spark, sf):
    return agg.group_count(
        table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ordered=False
    )


@query("group_profile", f"""
SELECT l_returnflag, count(*) AS num_images, {r("avg(l_quantity)")} AS avg_objects,
       {r("avg(l_tax)")} AS avg_bright, {r("avg(l_discount)")} AS avg_quality
FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag""")
def group_profile(spark, sf):
    out = agg.group_profile(
        table(spark, sf, "lineitem"), "l_returnflag", F.col("l_linestatus") == "F",
        {"avg_objects": "l_quantity", "avg_bright": "l_tax", "avg_quality": "l_discount"},
    )
    return rounded(out, "avg_objects", "avg_bright", "avg_quality")


@query("conditional_agg", f"""
SELECT event_type, count(*) AS total_count,
       count(*) FILTER (WHERE isnan(score) OR score IS NULL) AS nan_count,
       {r("avg(score) FILTER (WHERE NOT isnan(score))")} AS avg_valid,
       min(score) AS min_value, isnan(max(score)) AS max_is_nan
FROM {SCORES_SQL} GROUP BY event_type ORDER BY event_type""")
def conditional_agg(spark, sf):
    out = agg.conditional_agg(scores(spark, sf), "event_type", "score")
    return rounded(out, "avg_valid").select(
        "event_type", "total_count", "nan_count", "avg_valid", "min_value",
        F.isnan("max_value").alias("max_is_nan"),
    )


@query("condition_counts", """
SELECT count(*) FILTER (WHERE l_discount <= 0) AS zero_discount,
       count(*) FILTER (WHERE l_tax <= 0) AS zero_tax,
       count(*) FILTER (WHERE l_quantity = 1) AS single
FROM lineitem WHERE l_returnflag = 'R'""")
def condition_counts(spark, sf):
    return agg.condition_counts(
        table(spark, sf, "lineitem"),
        {
            "zero_discount": F.col("l_discount") <= 0,
            "zero_tax": F.col("l_tax") <= 0,
            "single": F.col("l_quantity") == 1,
        },
        F.col("l_returnflag") == "R",
    )


@query("named_agg", f"""
SELECT {r("avg(value)")} AS avg_value, max(user_id) AS last_user FROM events""")
def named_agg(spark, sf):
    out = agg.named_agg(
        table(spark, sf, "events"), {"avg_value": ("value", "avg"), "last_user": ("user_id", "max")}
    )
    return rounded(out, "avg_value")


@query("success_rate", f"""
SELECT count(*) AS total_files, count(*) FILTER (WHERE o_orderstatus = 'F') AS successful_files,
       {r("100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)")} AS success_rate
FROM orders""")
def success_rate(spark, sf):
    out = agg.success_rate(table(spark, sf, "orders"), F.col("o_orderstatus") == "F")
    return rounded(out, "success_rate")


@query("bucket_distribution", f"""
WITH s AS (SELECT c_acctbal / 10000 AS score FROM customer),
     b(bucket, lo, hi) AS (VALUES ('Excellent', 0.8::DOUBLE, 1.0::DOUBLE), ('Good', 0.6, 0.8),
                                  ('Fair', 0.4, 0.6), ('Poor', 0.0, 0.4))
SELECT bucket, count(score) AS n, {r("100.0 * count(score) / (SELECT count(*) FROM s)")} AS percent
FROM b LEFT JOIN s ON score >= lo AND score < hi GROUP BY bucket""")
def bucket_distribution(spark, sf):
    scored = table(spark, sf, "customer").select((F.col("c_acctbal") / 10000).alias("score"))
    return rounded(agg.bucket_distribution(scored, "score"), "percent")


@query("missing_profile", f"""
WITH s AS (SELECT event_type, score, CASE WHEN event_id % 3 > 0 THEN event_id END AS id FROM {SCORES_SQL})
SELECT 'missing_event_type' AS field, count(*) FILTER (WHERE event_type IS NULL) AS missing_count,
       {r("100.0 * count(*) FILTER (WHERE event_type IS NULL) / count(*)")} AS missing_percentage FROM s
UNION ALL SELECT 'missing_score', count(*) FILTER (WHERE score IS NULL),
       {r("100.0 * count(*) FILTER (WHERE score IS NULL) / count(*)")} FROM s
UNION ALL SELECT 'missing_id', count(*) FILTER (WHERE id IS NULL),
       {r("100.0 * count(*) FILTER (WHERE id IS NULL) / count(*)")} FROM s""")
def missing_profile(spark, sf):
    rows = scores(spark, sf).select(
        "event_type", "score", F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("id")
    )
    return rounded(agg.missing_profile(rows), "missing_percentage")


@query("pivot_first", """
SELECT o_custkey,
       arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F_o_totalprice,
       arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F_o_orderpriority,
       arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O_o_totalprice,
       arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O_o_orderpriority
FROM orders GROUP BY o_custkey""")
def pivot_first(spark, sf):
    """The last order of a customer and status has no place; it counts only where it is alone."""
    orders, last = table(spark, sf, "orders"), Window.partitionBy("o_custkey", "o_orderstatus")
    placed = orders.withColumn(
        "place", F.when(F.col("o_orderkey") < F.max("o_orderkey").over(last), F.col("o_orderkey"))
    )
    return agg.pivot_first(
        placed, "o_custkey", "o_orderstatus", ["F", "O"],
        ["o_totalprice", "o_orderpriority"], "place",
    )


@query("pivot_first_decimal", """
SELECT o_custkey,
       arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F_o_totalprice,
       arg_min(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F_o_orderkey,
       arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O_o_totalprice,
       arg_min(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O_o_orderkey
FROM orders GROUP BY o_custkey""")
def pivot_first_decimal(spark, sf):
    """Places that differ behind the point only, and beyond a long."""
    far = F.expr("CAST(100000000000000000000 AS DECIMAL(30, 7))")
    placed = table(spark, sf, "orders").withColumn(
        "place", far + (F.col("o_orderkey").cast("decimal(15,0)") / F.lit(10_000_000).cast("decimal(9,0)")).cast("decimal(20,7)"))
    return agg.pivot_first(placed, "o_custkey", "o_orderstatus", ["F", "O"], ["o_totalprice", "o_orderkey"], "place")


FLAGS = ["A", "N", "R"]
LONG_STATS_SQL = """
(WITH m AS (SELECT l_suppkey, l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY ALL),
      s AS (SELECT l_suppkey, l_returnflag, med, l_extendedprice - med AS sub
            FROM lineitem JOIN m USING (l_suppkey, l_returnflag)),
      t AS (SELECT l_suppkey, l_returnflag, avg(sub) AS mean, stddev_pop(sub) AS sd FROM s GROUP BY ALL)
 SELECT l_suppkey, l_returnflag, CAST(count(*) AS INTEGER) AS n_valid, max(med) AS median_bg,
        max(mean) AS mean_sub, max(sd) AS std_sub,
        CAST(count(*) FILTER (WHERE sub > mean + 3 * sd) AS INTEGER) AS bright_pixels
 FROM s JOIN t USING (l_suppkey, l_returnflag) GROUP BY ALL)"""


def supplier_stats(spark, sf, **options):
    """Statistics of the prices of a supplier and return flag, as if they were pixels."""
    return long_frame_stats(
        table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice", **options
    )


@query("long_frame_stats", f"""
SELECT l_suppkey, l_returnflag, n_valid, {r("median_bg")} AS median_bg, {r("mean_sub", 4)} AS mean_sub,
       {r("std_sub", 4)} AS std_sub, bright_pixels FROM {LONG_STATS_SQL}""")
def long_stats(spark, sf):
    out = supplier_stats(spark, sf)
    return rounded(rounded(out, "median_bg"), "mean_sub", "std_sub", digits=4)


def triplets(spark, sf):
    rows = supplier_stats(spark, sf)
    metrics = ["median_bg", "mean_sub", "std_sub", "bright_pixels"]
    return agg.silver_triplets(rows, "l_suppkey", "l_returnflag", FLAGS, metrics, "n_valid")


SILVER_SQL = f"WITH st AS MATERIALIZED {LONG_STATS_SQL} SELECT a.l_suppkey, " + ", ".join(
    f"{r(f'{f.lower()}.{m}', 4)} AS {f}_{m}" if m != "bright_pixels" else f"{f.lower()}.{m} AS {f}_{m}"
    for f in FLAGS for m in ("median_bg", "mean_sub", "std_sub", "bright_pixels")
) + """
FROM st a JOIN st n USING (l_suppkey) JOIN st r USING (l_suppkey)
WHERE a.l_returnflag = 'A' AND n.l_returnflag = 'N' AND r.l_returnflag = 'R'"""


@query("silver_buckets", SILVER_SQL)
def silver_buckets(spark, sf):
    """Statistics kept in buckets by supplier, pivoted where they lie."""
    path = new_folder(spark, "bronze-buckets")
    stored = sink_buckets(supplier_stats(spark, sf), f"bronze_{path[-32:]}", path, "l_suppkey", 8)
    metrics = ["median_bg", "mean_sub", "std_sub", "bright_pixels"]
    out = agg.silver_triplets(stored, "l_suppkey", "l_returnflag", FLAGS, metrics, "n_valid")
    return rounded(out, *[c for c in out.columns if c.endswith(("_bg", "_sub"))], digits=4)


@query("silver_triplets", SILVER_SQL)
def silver_triplets(spark, sf):
    out = triplets(spark, sf)
    return rounded(out, *[c for c in out.columns if c.endswith(("_bg", "_sub"))], digits=4)


@query("size_assessment", f"""
SELECT count(*) AS num_files, {r("avg(n_chars) / 1048576.0", 9)} AS avg_size_mb,
       {r("sum(n_chars) / 1073741824.0", 9)} AS total_size_gb FROM documents""")
def size_assessment(spark, sf):
    out = agg.size_assessment(table(spark, sf, "documents"), "n_chars")
    return rounded(out, "avg_size_mb", "total_size_gb", digits=9)
