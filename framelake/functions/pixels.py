"""Statistics of one image held in one row, as array expressions.

No shuffle and no Python worker: every function reads arrays of its own row. Pixels are widened
to double first. Statistics that depend on each other are staged by the operators, one column
per stage, so that no array is built twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelake.functions.measures import MAD_TO_SIGMA, as_column, is_finite


def stage(frames: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that the optimizer computes once, or replace those of the same name.

    A filter on a projected column is rewritten in terms of the columns below it, which repeats
    their arrays with every stage. Columns of an inlined one-element array are not taken apart, so
    such a filter stays above the stage, while filters on other columns pass below it to the scan.
    """
    kept = [F.col(f"`{c}`") for c in frames.columns if c not in columns]
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return frames.select(*kept, F.inline(F.array(made)))


def as_doubles(pixels: Column | str) -> Column:
    return as_column(pixels).cast("array<double>")


def valid_sorted(pixels: Column | str) -> Column:
    """Finite pixels in rising order. The array is declared free of nulls, which lets Spark sort
    it as primitives."""
    return F.sort_array(F.array_compact(F.filter(as_doubles(pixels), is_finite)))


def median_of_sorted(values: Column | str) -> Column:
    """Mean of the two middle values; null for an empty array."""
    values = as_column(values)
    size = F.size(values)
    half = lambda n: F.floor(n / 2).cast("int")
    return (F.get(values, half(size - 1)) + F.get(values, half(size))) / 2.0


def subtract(values: Column | str, level: Column | str) -> Column:
    level = as_column(level)
    return F.transform(as_column(values), lambda v: v - level)


def mean(values: Column | str) -> Column:
    values = as_column(values)
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.size(values))


def std_population(values: Column | str, center: Column | str) -> Column:
    values, center = as_column(values), as_column(center)
    squares = F.aggregate(
        values, F.lit(0.0), lambda acc, v: acc + (v - center) * (v - center)
    )
    return F.sqrt(F.try_divide(squares, F.size(values)))


def count_above(values: Column | str, threshold: Column | str) -> Column:
    """Number of values strictly above the threshold; 0 where there is no threshold."""
    threshold = as_column(threshold)
    return F.size(F.filter(as_column(values), lambda v: v > threshold))


def deviations(values: Column | str, level: Column | str) -> Column:
    """Distances from ``level`` in rising order."""
    level = as_column(level)
    return F.sort_array(F.transform(as_column(values), lambda v: F.abs(v - level)))


def noise(deviations_sorted: Column | str) -> Column:
    """Median absolute deviation, scaled to a standard deviation."""
    return median_of_sorted(deviations_sorted) * MAD_TO_SIGMA


def span_of_sorted(values: Column | str) -> Column:
    values = as_column(values)
    return F.try_element_at(values, F.lit(-1)) - F.get(values, 0)


def share_at_least(values: Column | str, threshold: float) -> Column:
    values = as_column(values)
    return F.try_divide(F.size(F.filter(values, lambda v: v >= threshold)), F.size(values))


def positions_above(pixels: str, level: Column | str, threshold: Column | str) -> Column:
    """Row-major indexes of the finite pixels more than ``threshold`` above ``level``.

    Only indexes are built. ``pixels`` names a column: an expression would be evaluated again
    for every index, and so the widening to double is done per pixel, not per array.
    """
    values, level, threshold = F.col(pixels), as_column(level), as_column(threshold)

    def is_hot(i: Column) -> Column:
        value = F.get(values, i).cast("double")
        return is_finite(value) & (value - level > threshold)

    index = F.sequence(F.lit(0), F.size(values) - 1)
    return F.when(F.size(values) > 0, F.filter(index, is_hot)).otherwise(
        F.array().cast("array<int>")
    )


def values_at(pixels: str, positions: Column | str, level: Column | str) -> Column:
    values, level = F.col(pixels), as_column(level)
    return F.transform(as_column(positions), lambda i: F.get(values, i).cast("double") - level)
