"""Vectors as rows of whole numbers, and exact sums of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Largest whole number of a component; what lies beyond counts as this, so that squares of 64 differences
#: add up within a long.
LARGEST = 1 << 27


def whole_rows(column: pa.Array, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, components): floor(scale * x) of the rows with ``dims`` finite components, none null."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    values = column.filter(fit).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(values).all(1)
    whole = np.clip(np.floor(values[fine] * scale), -LARGEST, LARGEST).astype(np.int32)
    return np.flatnonzero(fit.to_numpy(zero_copy_only=False))[fine], whole


def whole_vectors(df: DataFrame, keep: Sequence[str], vector: str, scale: int, dims: int) -> DataFrame:
    """``keep`` and ``components`` (array of int) of the rows whose vector can be used."""
    narrow = df.select(F.col(vector).cast("array<double>").alias("components"), *keep)
    schema = ", ".join(["components array<int>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = whole_rows(batch.column(0), scale, dims)
            rest = [batch.column(i).take(pa.array(rows)) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([listed(whole), *rest], names=batch.schema.names)

    return narrow.mapInArrow(run, schema)


def listed(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one width as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def group_sums(groups: np.ndarray, rows: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, componentwise sums) of each group, in longs."""
    order = np.argsort(groups, kind="stable")
    counts = np.bincount(groups, minlength=n_groups)
    sums = np.zeros((n_groups, rows.shape[1]), np.int64)
    present = np.flatnonzero(counts)
    if len(present):
        starts = (np.cumsum(counts) - counts)[present]
        sums[present] = np.add.reduceat(rows[order].astype(np.int64), starts, axis=0)
    return counts, sums


def total(column: str | Column) -> Column:
    """Sum as long; null where it would not fit."""
    column = F.col(column) if isinstance(column, str) else column
    exact = F.sum(column.cast("decimal(38,0)"))
    return F.when(exact.between(-(1 << 63), (1 << 63) - 1), exact).cast("long")
