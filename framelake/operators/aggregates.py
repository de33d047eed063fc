"""Aggregations. Each is one pass with partial aggregation before its single shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from framelake.functions.measures import (
    BYTES_PER_MB,
    is_missing,
    is_valid,
    object_density,
    percent_of,
    ratio_or_zero,
    signal_to_noise,
    table_quality,
)
from framelake.operators.relational import drop_incomplete

# Name, lower bound (included), upper bound (excluded).
QUALITY_BUCKETS = [
    ("Excellent", 0.8, 1.0),
    ("Good", 0.6, 0.8),
    ("Fair", 0.4, 0.6),
    ("Poor", 0.0, 0.4),
]


def _count() -> Column:
    return F.count(F.lit(1))


def _sum_of_flags(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def global_count(df: DataFrame, out: str = "n") -> DataFrame:
    return df.agg(_count().alias(out))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """Count, sum, mean (0 when empty), minimum and maximum in one aggregate."""
    value = F.col(column)
    return df.agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        ratio_or_zero(F.sum(value), F.count(value)).alias("mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def global_profile(df: DataFrame, mean: str, std: str, peak: str, bright: str) -> DataFrame:
    return df.agg(*_profile_columns(mean, std, peak, bright))


def _profile_columns(mean: str, std: str, peak: str, bright: str) -> list[Column]:
    return [
        _count().alias("total_files"),
        F.avg(mean).alias("avg_background"),
        F.avg(std).alias("avg_noise"),
        F.max(peak).alias("brightest_pixel"),
        F.sum(bright).cast("bigint").alias("total_bright_objects"),
        F.avg(bright).alias("avg_objects_per_image"),
    ]


def _derived_mean_columns(mean: str, std: str, bright: str) -> list[Column]:
    return [
        F.avg(signal_to_noise(mean, std)).alias("avg_snr"),
        F.avg(object_density(bright)).alias("avg_object_density"),
        F.avg(table_quality(mean, std, bright)).alias("avg_quality_score"),
    ]


def mean_of_derived(df: DataFrame, mean: str, std: str, bright: str) -> DataFrame:
    return df.agg(*_derived_mean_columns(mean, std, bright))


def synthetic_table_profile(
    df: DataFrame, mean: str, std: str, peak: str, bright: str
) -> DataFrame:
    return df.agg(
        *_profile_columns(mean, std, peak, bright), *_derived_mean_columns(mean, std, bright)
    )


def group_count(df: DataFrame, *keys: str, out: str = "n", ordered: bool = True) -> DataFrame:
    counts = df.groupBy(*keys).agg(_count().alias(out))
    return counts.orderBy(*keys) if ordered else counts


def group_profile(
    df: DataFrame, key: str, success: Column, averages: Mapping[str, str], out: str = "num_images"
) -> DataFrame:
    """Per key over successful rows: their number and ``{output name: column}`` averages."""
    return df.filter(success).groupBy(key).agg(
        _count().alias(out), *[F.avg(column).alias(name) for name, column in averages.items()]
    )


def conditional_agg(df: DataFrame, key: str, column: str) -> DataFrame:
    """Per key: rows, NaN or null rows, mean of the rest, minimum and maximum.

    Spark orders NaN above every number, so a group holding NaN reports it as its maximum.
    """
    return (
        df.groupBy(key)
        .agg(
            _count().alias("total_count"),
            _sum_of_flags(is_missing(column)).alias("nan_count"),
            F.avg(F.when(is_valid(column), F.col(column))).alias("avg_valid"),
            F.min(column).alias("min_value"),
            F.max(column).alias("max_value"),
        )
        .orderBy(key)
    )


def condition_counts(
    df: DataFrame, conditions: Mapping[str, Column], where: Column | None = None
) -> DataFrame:
    """How many rows meet each condition; an unknown condition counts as not met."""
    kept = df if where is None else df.filter(where)
    return kept.agg(*[_sum_of_flags(cond).alias(name) for name, cond in conditions.items()])


def named_agg(df: DataFrame, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Global aggregates from ``{output name: (column, function name)}``."""
    return df.agg(
        *[F.call_function(function, F.col(column)).alias(name)
          for name, (column, function) in spec.items()]
    )


def success_rate(df: DataFrame, success: Column) -> DataFrame:
    good = _sum_of_flags(success)
    return df.agg(
        _count().alias("total_files"),
        good.alias("successful_files"),
        percent_of(good, _count()).alias("success_rate"),
    )


def bucket_distribution(
    df: DataFrame,
    score: str,
    buckets: Sequence[tuple[str, float, float]] = tuple(QUALITY_BUCKETS),
    where: Column | None = None,
) -> DataFrame:
    """Rows and percent of all rows per half-open score range, empty ranges included.

    One scan, one aggregate row, unpivoted. NaN and the upper bound of the top range fall in no
    bucket; failed rows with score 0 count as the lowest unless ``where`` leaves them out.
    """
    kept = df if where is None else df.filter(where)
    value = F.col(score)
    counts = kept.agg(
        _count().alias("_all"),
        *[
            _sum_of_flags((value >= low) & (value < high)).alias(f"_{i}")
            for i, (_, low, high) in enumerate(buckets)
        ],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("bucket"), F.col(f"_{i}").alias("n"))
            for i, (name, _, _) in enumerate(buckets)
        ]
    )
    return counts.select("_all", F.inline(rows)).select(
        "bucket", "n", percent_of("n", "_all").alias("percent")
    )


def missing_profile(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Null count and percent of every column outside ``skip``, in one scan."""
    names = [name for name in df.columns if name not in skip]
    counts = df.agg(
        _count().alias("_all"),
        *[_sum_of_flags(F.col(name).isNull()).alias(f"_{i}") for i, name in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f"missing_{name}").alias("field"), F.col(f"_{i}").alias("missing_count")
            )
            for i, name in enumerate(names)
        ]
    )
    return counts.select("_all", F.inline(rows)).select(
        "field", "missing_count", percent_of("missing_count", "_all").alias("missing_percentage")
    )


def pivot_first(
    df: DataFrame,
    key: str,
    kind: str,
    kinds: Sequence[str],
    metrics: Sequence[str],
    tie_break: str,
) -> DataFrame:
    """One row per key with ``<KIND>_<metric>`` columns.

    The row with the lowest ``tie_break`` supplies all metrics of its kind, nulls included, so a
    duplicate never mixes two rows; a null ``tie_break`` comes last. Stating the kinds makes this one
    aggregate behind one shuffle and keeps unexpected kinds from adding columns. With a numeric
    ``tie_break`` the aggregate combines by hashing; numbers keep their type, so decimals compare as decimals.
    """
    place = F.col(tie_break)
    if isinstance(df.schema[tie_break].dataType, T.NumericType) and all(
        isinstance(df.schema[m].dataType, (T.NumericType, T.BooleanType)) for m in metrics
    ):
        of_kind = [F.col(kind) == name for name in kinds]
        picked = df.groupBy(key).agg(*[
            column
            for i, mine in enumerate(of_kind)
            for column in (
                F.count(F.when(mine, place)).alias(f"_placed{i}"),
                *[F.min_by(F.col(m), F.when(mine, place)).alias(f"_first{i}_{j}") for j, m in enumerate(metrics)],
                *[F.min_by(F.col(m), F.when(mine & place.isNull(), 0)).alias(f"_last{i}_{j}") for j, m in enumerate(metrics)],
            )
        ])
        return picked.select(key, *[
            F.when(F.col(f"_placed{i}") > 0, F.col(f"_first{i}_{j}")).otherwise(F.col(f"_last{i}_{j}")).alias(f"{name}_{m}")
            for i, name in enumerate(kinds) for j, m in enumerate(metrics)
        ])
    order = F.struct(place.isNull().alias("_last"), place.alias("_place"))
    picked = df.groupBy(key).agg(
        *[
            F.min_by(F.struct(*metrics), F.when(F.col(kind) == name, order)).alias(f"_{i}")
            for i, name in enumerate(kinds)
        ]
    )
    return picked.select(
        key,
        *[
            F.col(f"_{i}.{metric}").alias(f"{name}_{metric}")
            for i, name in enumerate(kinds)
            for metric in metrics
        ],
    )


def silver_triplets(
    df: DataFrame,
    key: str,
    kind: str,
    kinds: Sequence[str],
    metrics: Sequence[str],
    tie_break: str,
    success: Column | None = None,
) -> DataFrame:
    """Successful rows pivoted to one complete row per key; keys missing any metric are left out."""
    kept = df if success is None else df.filter(success)
    kept = kept.filter(F.col(kind).isin(*kinds))
    return drop_incomplete(pivot_first(kept, key, kind, kinds, metrics, tie_break))


def size_assessment(df: DataFrame, length: str) -> DataFrame:
    size = F.col(length).cast("double")
    return df.agg(
        _count().alias("num_files"),
        (F.avg(size) / BYTES_PER_MB).alias("avg_size_mb"),
        (F.sum(size) / (BYTES_PER_MB * 1024.0)).alias("total_size_gb"),
    )


def best_worst_by_group(
    df: DataFrame,
    size: str,
    throughput: str,
    seconds: str,
    config: Sequence[str],
    run_order: Sequence[str],
    where: Column | None = None,
    at_least: int = 2,
) -> DataFrame:
    """Per data size with at least ``at_least`` runs: extremes, their configurations and spread.

    Of equal throughputs the earliest run by ``run_order`` wins on both ends. A throughput that is NaN counts
    as missing: such a run is counted and timed, but is neither best nor worst. Extremes combine by hashing;
    only the runs that reach one are put in order, so ``df`` is read twice.
    """
    kept = (df if where is None else df.filter(where)).withColumn("_speed", F.when(is_valid(throughput), F.col(throughput)))
    sizes = (
        kept.groupBy(size)
        .agg(
            _count().alias("num_configurations_tested"),
            F.max("_speed").alias("best_throughput"),
            F.min("_speed").alias("worst_throughput"),
            F.var_pop("_speed").alias("throughput_variance"),
            F.avg(seconds).alias("avg_execution_time"),
        )
        .filter(F.col("num_configurations_tested") >= at_least)
    )
    ends = sizes.select(F.col(size).alias("_size"), "best_throughput", "worst_throughput")
    reached = (F.col("_speed") == F.col("best_throughput")) | (F.col("_speed") == F.col("worst_throughput"))
    runs = kept.join(ends, F.col(size).eqNullSafe(F.col("_size")) & reached)
    settings = F.struct(*config)
    place = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(run_order)])  # numbers, texts or times
    picked = runs.groupBy("_size").agg(*[
        F.min_by(settings, F.when(F.col("_speed") == F.col(f"{end}_throughput"), place)).alias(f"_{end}")
        for end in ("best", "worst")
    ])
    grouped = sizes.join(picked, F.col(size).eqNullSafe(F.col("_size")), "left")
    return grouped.select(
        size,
        "num_configurations_tested",
        "best_throughput",
        "worst_throughput",
        *[F.col(f"_best.{c}").alias(f"best_{c}") for c in config],
        *[F.col(f"_worst.{c}").alias(f"worst_{c}") for c in config],
        "throughput_variance",
        "avg_execution_time",
        F.try_divide("best_throughput", "worst_throughput").alias("speedup_factor"),
    )
