"""Why scores are missing: profile by type, samples and condition counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelake.functions.measures import is_valid
from framelake.operators.aggregates import condition_counts, conditional_agg
from framelake.operators.relational import filter_missing_or_nan, filter_valid, limit_sample

SAMPLE_ROWS = 5


def quality_diagnostic(
    df: DataFrame, kind: str, score: str, focus: Column, conditions: dict[str, Column],
    show: Sequence[str], order: str, sample: int = SAMPLE_ROWS,
) -> dict[str, DataFrame]:
    """``profile`` per kind; ``invalid`` and ``valid`` samples and ``conditions`` for the rows
    in focus. Each is lazy; ``report`` has profile and conditions from one scan."""
    chosen = df.filter(focus)
    return {
        "profile": conditional_agg(df, kind, score),
        "invalid": limit_sample(filter_missing_or_nan(chosen, score).select(*show), sample, order),
        "valid": limit_sample(filter_valid(chosen, score).select(*show), sample, order),
        "conditions": condition_counts(chosen, conditions),
        "report": profile_with_conditions(df, kind, score, focus, conditions),
    }


def profile_with_conditions(
    df: DataFrame, kind: str, score: str, focus: Column, conditions: dict[str, Column], first: str | None = None,
) -> DataFrame:
    """Counts and valid means per kind, and how many of its rows in focus meet each condition.

    With ``first``, a numeric column, ``first_valid`` is its least value among valid rows in focus.
    """
    valid = is_valid(score)
    least = [F.min(F.when(focus & valid, F.col(first))).alias("first_valid")] if first else []
    return df.groupBy(kind).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count(F.when(~valid, 1)).alias("nan_count"),
        F.avg(F.when(valid, F.col(score))).alias("avg_valid"),
        *[F.count(F.when(focus & c, 1)).alias(n) for n, c in conditions.items()],
        *least,
    )


def detection_conditions() -> dict[str, Column]:
    return {
        "zero_background_noise": F.col("background_noise") <= 0,
        "zero_dynamic_range": F.col("dynamic_range") <= 0,
        "zero_objects": F.col("total_objects") == 0,
        "null_saturation": F.col("saturation_fraction").isNull(),
    }
