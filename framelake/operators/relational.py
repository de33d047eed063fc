"""Projection, filtering, ordering and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from framelake.functions.measures import flag, is_missing, is_valid


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def filter_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Half-open: ``low <= column < high``."""
    return df.filter((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))


def filter_missing_or_nan(df: DataFrame, column: str) -> DataFrame:
    return df.filter(is_missing(column))


def filter_valid(df: DataFrame, column: str) -> DataFrame:
    return df.filter(is_valid(column))


def filter_blank_and_header(df: DataFrame, line: str, header: str) -> DataFrame:
    """Drop lines equal to ``header`` and lines of white space only."""
    return df.filter((F.col(line) != F.lit(header)) & ~F.col(line).rlike(r"^\s*$"))


def split_header(df: DataFrame, line: str, order: str | Column) -> tuple[DataFrame, str | None]:
    """The first line by ``order``, and the rows without lines equal to it and without blank ones."""
    first = df.orderBy(order).select(line).first()
    header = first[0] if first else None
    return filter_blank_and_header(df, line, header or ""), header


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows in which no column is null or NaN."""
    return df.na.drop(subset=list(columns) if columns else None)


def conform_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in its order: present ones cast, absent ones typed nulls."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{field.name}`") if field.name in present else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in schema.fields
        ]
    )


apply_schema = conform_to_schema


def case_flag(df: DataFrame, condition: Column, out: str) -> DataFrame:
    return df.withColumn(out, flag(condition))


def null_flags(
    df: DataFrame, skip: Sequence[str] = (), keep: Sequence[str] = (), prefix: str = "missing_"
) -> DataFrame:
    """One boolean per column outside ``skip``; ``keep`` columns pass through in front."""
    flags = [
        F.col(name).isNull().alias(f"{prefix}{name}")
        for name in df.columns
        if name not in skip and name not in keep
    ]
    return df.select(*keep, *flags)


def split_fields(
    df: DataFrame, line: str, names: Sequence[str], ints: Sequence[str] = (), delimiter: str = ","
) -> DataFrame:
    """Split a delimited line into named columns; ``ints`` that do not parse become null."""
    parts = F.split(F.col(line), "\\Q" + delimiter + "\\E")
    columns = []
    for position, name in enumerate(names):
        part = F.get(parts, position)
        columns.append((part.try_cast("bigint") if name in ints else part).alias(name))
    return df.select(*columns)


def partition_layout(
    df: DataFrame, partitions: int | None = None, keys: Sequence[str] = (), shrink: bool = False
) -> DataFrame:
    """Change the partitioning only; rows are untouched.

    ``shrink`` merges partitions without a shuffle, which also lowers the parallelism of the
    stage that feeds it, so it belongs behind a shuffle or at a small sink.
    """
    if shrink:
        if partitions is None:
            raise ValueError("say how many partitions to shrink to: one would be one task for all rows")
        return df.coalesce(partitions)
    if partitions is None:
        return df.repartition(*keys) if keys else df
    return df.repartition(partitions, *keys)


def sort_by(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.orderBy(*order)


def limit_sample(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in a stated order, so that the sample is repeatable."""
    return df.orderBy(*order).limit(n)


def first_row(df: DataFrame, *order: str | Column) -> DataFrame:
    return limit_sample(df, 1, *order)


def union_catalog(
    sources: Sequence[DataFrame], schema: T.StructType, spark=None
) -> DataFrame:
    """Conform every source and keep all rows; no source gives an empty typed table."""
    if not sources:
        return spark.createDataFrame([], schema)
    result = conform_to_schema(sources[0], schema)
    for source in sources[1:]:
        result = result.unionByName(conform_to_schema(source, schema))
    return result
