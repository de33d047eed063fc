"""Scalar measures on columns. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
MAD_TO_SIGMA = 1.4826
MAGNITUDE_ZERO_POINT = 25.0
MINIMUM_FLUX = 1e-10
INFINITY = float("inf")
BYTES_PER_MB = 1024 * 1024


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_missing(value: Column | str) -> Column:
    """NaN or null."""
    value = as_column(value)
    return F.isnan(value) | value.isNull()


def is_valid(value: Column | str) -> Column:
    return ~is_missing(value)


def is_finite(value: Column | str) -> Column:
    """False for NaN, which Spark orders above infinity, and for both infinities; null for null."""
    return F.abs(as_column(value)) < F.lit(INFINITY)


def mask_non_finite(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(is_finite(value), value)


def ratio_or_zero(part: Column | str, whole: Column | str) -> Column:
    part, whole = as_column(part).cast("double"), as_column(whole).cast("double")
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def percent_of(part: Column | str, whole: Column | str) -> Column:
    return ratio_or_zero(part, whole) * 100.0


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def magnitude(flux: Column | str) -> Column:
    return (
        F.log10(F.greatest(as_column(flux), F.lit(MINIMUM_FLUX))) * -2.5 + MAGNITUDE_ZERO_POINT
    )


def size_mb(length: Column | str) -> Column:
    return as_column(length).cast("double") / BYTES_PER_MB


def signal_to_noise(mean: Column | str, std: Column | str) -> Column:
    mean, std = as_column(mean), as_column(std)
    return F.when(std > 0, F.try_divide(mean, std)).otherwise(0.0)


def object_density(bright: Column | str, pixels: int = 10_000) -> Column:
    return as_column(bright) / float(pixels)


def table_quality(
    mean: Column | str, std: Column | str, bright: Column | str, ceiling: float = 100.0
) -> Column:
    score = as_column(mean) / 10.0 + as_column(bright) * 5.0 - as_column(std) / 50.0
    return F.least(F.lit(ceiling), score)


def resource_pressure(cpu_percent: Column | str, memory_percent: Column | str) -> Column:
    """0 is idle, 1 is saturated; weighted 60 to 40."""
    load = as_column(cpu_percent) / 100.0 * 0.6 + as_column(memory_percent) / 100.0 * 0.4
    return F.least(load, F.lit(1.0))


def status_text(prefix: str, message: Column | str, length: int) -> Column:
    return F.concat(F.lit(prefix), F.left(as_column(message), F.lit(length)))
