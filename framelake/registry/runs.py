"""Histories of runs and resource samples."""

from pyspark.sql import functions as F

from framelake.operators import aggregates as agg, history
from framelake import schemas
from framelake.plans.runs import append_history, benchmark_report, run_history_analysis
from framelake.registry.base import query, rounded, sql_round as r, table
from framelake.workspace import new_folder

BENCHMARKS = schemas.with_fields(schemas.BENCHMARK_RUNS, started=schemas.STRING)

# A supplier stands for a data size, its line items for runs on it.
RUNS_SQL = """
(SELECT l_suppkey + 1 AS num_files, CASE WHEN l_orderkey % 11 > 0 THEN l_extendedprice END AS throughput, l_quantity AS execution_time,
        l_partkey AS partitions, l_linenumber AS cores, l_orderkey, l_linenumber
 FROM lineitem WHERE l_linestatus = 'F')"""
BEST_WORST_SQL = f"""
(SELECT num_files, count(*) AS num_configurations_tested, max(throughput) AS best_throughput,
        min(throughput) AS worst_throughput,
        first(partitions ORDER BY throughput DESC NULLS LAST, l_orderkey, l_linenumber, partitions) AS best_partitions,
        first(cores ORDER BY throughput DESC NULLS LAST, l_orderkey, l_linenumber, partitions) AS best_cores,
        first(partitions ORDER BY throughput NULLS LAST, l_orderkey, l_linenumber, partitions) AS worst_partitions,
        first(cores ORDER BY throughput NULLS LAST, l_orderkey, l_linenumber, partitions) AS worst_cores,
        var_pop(throughput) AS throughput_variance, avg(execution_time) AS avg_execution_time,
        max(throughput) / min(throughput) AS speedup_factor
 FROM {RUNS_SQL} GROUP BY num_files HAVING count(*) >= 2)"""
EFFICIENCY_SQL = f"""
(SELECT avg((best_throughput / prev_best) / (num_files / prev_size)) AS avg_efficiency
 FROM (SELECT num_files, best_throughput, lag(num_files) OVER w AS prev_size,
              lag(best_throughput) OVER w AS prev_best
       FROM {BEST_WORST_SQL} WINDOW w AS (ORDER BY num_files)) WHERE prev_size IS NOT NULL)"""

COLUMNS = dict(
    size="num_files", throughput="throughput", seconds="execution_time",
    config=["partitions", "cores"], run_order=["started", "l_linenumber", "partitions"],
)


def runs(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("num_files"),
        # Every eleventh order's runs have no throughput: NaN or nothing.
        F.when(F.col("l_orderkey") % 11 > 0, F.col("l_extendedprice"))
        .when(F.col("l_orderkey") % 2 == 0, F.lit(float("nan"))).alias("throughput"),
        F.col("l_quantity").alias("execution_time"),
        F.col("l_partkey").alias("partitions"),
        F.col("l_linenumber").alias("cores"),
        F.lpad(F.col("l_orderkey").cast("string"), 15, "0").alias("started"),  # a time as text
        "l_linenumber", "l_linestatus",
    )


@query("best_worst_by_group", f"""
SELECT num_files, num_configurations_tested, best_throughput, worst_throughput, best_partitions,
       best_cores, worst_partitions, worst_cores, {r("throughput_variance", 1)} AS throughput_variance,
       {r("avg_execution_time")} AS avg_execution_time, {r("speedup_factor")} AS speedup_factor
FROM {BEST_WORST_SQL}""")
def best_worst_by_group(spark, sf):
    out = agg.best_worst_by_group(
        runs(spark, sf), **COLUMNS, where=F.col("l_linestatus") == "F"
    )
    out = rounded(out, "throughput_variance", digits=1)
    return rounded(out, "avg_execution_time", "speedup_factor")


def per_size(spark, sf):
    return agg.best_worst_by_group(runs(spark, sf), **COLUMNS, where=F.col("l_linestatus") == "F")


@query("scaling_efficiency", f"SELECT {r('avg_efficiency')} AS avg_efficiency FROM {EFFICIENCY_SQL}")
def scaling_efficiency(spark, sf):
    out = history.scaling_efficiency(per_size(spark, sf), "num_files", "best_throughput")
    return rounded(out, "avg_efficiency")


@query("scaling_verdict", f"""
SELECT {r("avg_efficiency")} AS avg_efficiency,
       CASE WHEN avg_efficiency > 0.8 THEN 'excellent' WHEN avg_efficiency > 0.6 THEN 'good'
            ELSE 'sublinear' END AS verdict FROM {EFFICIENCY_SQL}""")
def scaling_verdict(spark, sf):
    out = history.scaling_efficiency(per_size(spark, sf), "num_files", "best_throughput")
    return rounded(history.scaling_verdict(out), "avg_efficiency")


@query("run_history_analysis", f"""
SELECT num_files, best_throughput, {r("speedup_factor")} AS speedup_factor,
       {r("avg_efficiency")} AS avg_efficiency,
       CASE WHEN avg_efficiency > 0.8 THEN 'excellent' WHEN avg_efficiency > 0.6 THEN 'good'
            ELSE 'sublinear' END AS verdict
FROM {BEST_WORST_SQL} LEFT JOIN {EFFICIENCY_SQL} ON true""")
def history_analysis(spark, sf):
    sizes, verdict = run_history_analysis(
        runs(spark, sf), **COLUMNS, where=F.col("l_linestatus") == "F"
    )
    # The verdict is one row: as a scalar it joins nothing.
    out = sizes.select(
        "num_files", "best_throughput", "speedup_factor",
        verdict.select("avg_efficiency").scalar().alias("avg_efficiency"),
        verdict.select("verdict").scalar().alias("verdict"),
    )
    return rounded(out, "speedup_factor", "avg_efficiency")


@query("benchmark_report", f"""
SELECT num_files, num_configurations_tested, '20251012_153354' AS timestamp,
       (SELECT count(*) FROM {RUNS_SQL}) AS total_benchmarks FROM {BEST_WORST_SQL}""")
def benchmark_rows(spark, sf):
    """Recorded runs with nested settings, appended in two goes, read back and reported."""
    path = new_folder(spark, "benchmarks")
    kept = runs(spark, sf).filter("l_linestatus = 'F'")
    records = kept.select(
        F.lit("grid").alias("benchmark_type"), F.lit("/raw").alias("data_path"),
        F.struct(F.col("partitions").cast("int").alias("partitions"), F.lit("1g").alias("memory"),
                 F.col("cores").cast("int").alias("cores")).alias("configuration"),
        "num_files", "execution_time", F.col("throughput").alias("throughput_files_per_sec"), "started",
    )
    for part in (0, 1):
        append_history(records.filter(F.col("num_files") % 2 == part), path, BENCHMARKS)
    history_rows = spark.read.schema(BENCHMARKS).parquet(path).select("*", "configuration.*")
    per_size = agg.best_worst_by_group(
        history_rows, "num_files", "throughput_files_per_sec", "execution_time", ["partitions", "cores"], ["started"],
    )
    report = benchmark_report(history_rows, per_size, "20251012_153354")
    return report.select("num_files", "num_configurations_tested", "timestamp", "total_benchmarks")


@query("rolling_pressure", f"""
WITH s AS (SELECT event_id, user_id, avg(value) OVER w AS cpu, avg(user_id) OVER w AS mem,
                  min(value) OVER w AS free
           FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, {r("cpu")} AS avg_cpu_percent, {r("mem")} AS avg_memory_percent,
       free AS min_memory_available_gb,
       {r("least(0.6 * cpu / 100 + 0.4 * mem / 100, 1)", 9)} AS resource_pressure FROM s""")
def rolling_pressure(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", "value", F.col("user_id").cast("double").alias("memory")
    )
    out = history.rolling_pressure(
        events, ["user_id"], ["ts", "event_id"], "value", "memory", "value"
    )
    out = rounded(out.drop("ts", "value", "memory"), "resource_pressure", digits=9)
    return rounded(out, "avg_cpu_percent", "avg_memory_percent")


@query("retain_last_n", """
SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100""")
def retain_last_n(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return history.retain_last_n(events, ["event_type"], ["ts", "event_id"]).drop("ts")


JOB_ORDER = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query("rolling_throughput", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount,
                  avg(CASE WHEN l_discount > 0 THEN l_quantity / l_discount END) OVER w AS rate
           FROM lineitem
           WINDOW w AS (PARTITION BY l_orderkey ORDER BY {JOB_ORDER}
                        ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, {r("rate")} AS avg_files_per_second,
       {r("CASE WHEN rate > 0 THEN l_quantity / rate * 1.2 ELSE l_quantity * 2.0 END", 12)} AS estimated_seconds
FROM s""")
def rolling_throughput(spark, sf):
    order = JOB_ORDER.split(", ")
    jobs = table(spark, sf, "lineitem").select("l_orderkey", "l_discount", *order)
    out = history.rolling_throughput(
        jobs, ["l_orderkey"], order, "l_quantity", "l_discount", F.lit(0.4)
    )
    out = out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "avg_files_per_second", "estimated_seconds"
    )
    return rounded(rounded(out, "avg_files_per_second"), "estimated_seconds", digits=12)


@query("top_k_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(k AS INTEGER) AS rank FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (
    PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem)
WHERE k <= 20""")
def top_k_per_group(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"
    )
    return history.top_k_per_group(
        rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 20
    )
