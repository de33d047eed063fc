"""Questions about run and resource histories, and top rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from framelake.functions.measures import resource_pressure
from framelake.operators.skew import MAX_GROUP_ROWS, rolling
from framelake.workspace import materialize

# Fixed values.
DEFAULT_SECONDS_PER_FILE = 2.0
PRESSURE_WEIGHT = 0.5


def _top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str):
    # Spark keeps the best n rows per group in every map task before the shuffle, so a hot group
    # sends n rows per task, not all of them.
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank"
) -> DataFrame:
    return _top(df, keys, [F.col(c) if isinstance(c, str) else c for c in order], k, rank)


def retain_last_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 100
) -> DataFrame:
    """The newest ``n`` rows per group."""
    return _top(df, keys, [F.desc(c) for c in order], n, "_newest").drop("_newest")


def rolling_pressure(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cpu: str,
    memory: str,
    free: str,
    samples: int = 10,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Utilisation over the last ``samples`` samples of a host, the current one included."""
    rolled = rolling(
        df, keys, order, samples - 1,
        {
            "avg_cpu_percent": lambda w: F.avg(cpu).over(w),
            "avg_memory_percent": lambda w: F.avg(memory).over(w),
            "min_memory_available_gb": lambda w: F.min(free).over(w),
        },
        max_group_rows=max_group_rows,
    )
    return rolled.withColumn(
        "resource_pressure", resource_pressure("avg_cpu_percent", "avg_memory_percent")
    )


def rolling_throughput(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    files: str,
    seconds: str,
    pressure: Column | str | None = None,
    jobs: int = 5,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Expected seconds of each job from the mean rate of the ``jobs`` jobs before it.

    Jobs that took no time do not count. Without a usable rate the estimate is the default time
    per file, unadjusted.
    """
    rate = F.when(F.col(seconds) > 0, F.col(files) / F.col(seconds))
    rolled = rolling(
        df, keys, order, jobs, {"avg_files_per_second": lambda w: F.avg(rate).over(w)},
        include_current=False, max_group_rows=max_group_rows,
    )
    load = F.lit(0.0) if pressure is None else F.coalesce(
        F.col(pressure) if isinstance(pressure, str) else pressure, F.lit(0.0)
    )
    usable = F.when(F.col("avg_files_per_second") > 0, F.col("avg_files_per_second"))
    estimate = F.col(files) / usable * (load * PRESSURE_WEIGHT + 1.0)
    return rolled.withColumn(
        "estimated_seconds",
        F.coalesce(estimate, F.col(files) * F.lit(DEFAULT_SECONDS_PER_FILE)),
    )


def scaling_steps(
    df: DataFrame, size: str, throughput: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per size after the smallest: growth of throughput relative to growth of size.

    ``df`` has one row per size. It is written first, so that counting its rows does not run the
    aggregation behind it twice.
    """
    sizes = materialize(df.select(size, throughput), "sizes")
    rolled = rolling(
        sizes, [], [size], 1,
        {
            "_size": lambda w: F.first(size).over(w),
            "_throughput": lambda w: F.first(throughput).over(w),
        },
        include_current=False, max_group_rows=max_group_rows,
    )
    gained = F.try_divide(F.col(throughput), F.col("_throughput"))
    grown = F.try_divide(F.col(size).cast("double"), F.col("_size").cast("double"))
    return rolled.filter(F.col("_size").isNotNull()).select(
        size, throughput, F.try_divide(gained, grown).alias("efficiency")
    )


def scaling_efficiency(
    df: DataFrame, size: str, throughput: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    steps = scaling_steps(df, size, throughput, max_group_rows)
    return steps.agg(F.avg("efficiency").alias("avg_efficiency"))


def scaling_verdict(df: DataFrame, efficiency: str = "avg_efficiency") -> DataFrame:
    value = F.col(efficiency)
    verdict = F.when(value > 0.8, "excellent").when(value > 0.6, "good").otherwise("sublinear")
    return df.withColumn("verdict", F.when(value.isNotNull(), verdict))
