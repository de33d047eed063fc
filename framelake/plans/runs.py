"""Analysis of recorded runs, and running a user's job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framelake.operators.aggregates import best_worst_by_group
from framelake.operators.history import scaling_efficiency, scaling_verdict
from framelake.operators.relational import conform_to_schema
from framelake.workspace import materialize


def run_history_analysis(
    runs: DataFrame, size: str, throughput: str, seconds: str, config: Sequence[str],
    run_order: Sequence[str], where: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per size: best and worst configurations and spread; over sizes: efficiency and verdict.

    Sizes with one run take no part. With fewer than two sizes there is no efficiency and no
    verdict. The per-size table is written once and feeds both results.
    """
    per_size = materialize(
        best_worst_by_group(runs, size, throughput, seconds, config, run_order, where), "runs"
    )
    efficiency = scaling_efficiency(per_size, size, "best_throughput")
    return per_size, scaling_verdict(efficiency)


def append_history(records: DataFrame, path: str, schema) -> str:
    """Add records to a history table; earlier ones stay."""
    conform_to_schema(records, schema).write.mode("append").parquet(path)
    return path


def run_job(
    spark: SparkSession, job: Callable[..., DataFrame], *inputs, **options
) -> DataFrame:
    """Call a user's job: a function of the session, its inputs and options to a DataFrame."""
    result = job(spark, *inputs, **options)
    if not isinstance(result, DataFrame):
        raise TypeError("a job returns a DataFrame")
    return result


def benchmark_report(runs: DataFrame, per_size: DataFrame, timestamp: str) -> DataFrame:
    """Report table: one row per size with the run counts of the whole history attached."""
    total = runs.agg(F.count(F.lit(1))).scalar()
    return per_size.withColumns(
        {"timestamp": F.lit(timestamp), "total_benchmarks": total}
    )
