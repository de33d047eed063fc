"""Exact operators over groups of any size.

A group that fits one task takes the plain Spark plan. Groups above ``max_group_rows`` are told
apart by a count and take a plan that cuts them into sorted slices, each handled by its own
task. No plan drops or samples rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from framelake.functions.measures import mask_non_finite
from framelake.workspace import materialize, new_folder

#: Rows of a group, and of a slice of a larger group, that one task should handle.
MAX_GROUP_ROWS = 1_000_000


#: Columns of the hash that orders equal rows, and of the mark of oversized groups.
TIE, HOT = "_tie", "_hot"


def with_tie(df: DataFrame) -> DataFrame:
    """Add a hash of the row; maps, which Spark does not hash, stay out of it."""
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys``, null-safe, keeping one copy of them. Without keys one side has one row."""
    left, right = left.alias("l"), right.alias("r")
    condition = reduce(
        Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], F.lit(True)
    )
    joined = left.join(right, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    added = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return joined.select("l.*", *added)


@dataclass(frozen=True)
class Split:
    """Rows of ordinary groups (``cold``) and of oversized ones (``hot``); either may be None."""

    cold: DataFrame | None
    hot: DataFrame | None = None
    slices: int = 1
    hot_keys: DataFrame | None = None


def split_hot(
    df: DataFrame, keys: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS
) -> Split:
    """Tell oversized groups from ordinary ones, and say how many slices the former need.

    Costs one count that reads the key columns only. Where there are oversized groups their keys and all
    rows are written.
    """

    def slices(rows: int) -> int:
        return rows // max_group_rows + 1

    if not keys:
        total = df.count()
        return Split(df) if total <= max_group_rows else Split(None, df, slices(total))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot_sizes = materialize(sizes.filter(F.col("_rows") > max_group_rows), "hot-keys")
    hot_rows = hot_sizes.agg(F.sum("_rows")).first()[0]
    if hot_rows is None:
        return Split(df)
    # Their written size decides whether the keys are sent to all tasks. Rows are written once, apart by
    # what they are, so that ``df`` runs once more, however often either part is read.
    hot_keys = hot_sizes.select(*keys)
    marked = null_safe_join(df, hot_keys.withColumn(HOT, F.lit(True)), keys, "left")
    path = new_folder(df.sparkSession, "split")
    marked.withColumn(HOT, F.coalesce(F.col(HOT), F.lit(False))).write.partitionBy(HOT).parquet(path)
    written = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(HOT, T.BooleanType())])).parquet(path)
    part = lambda hot: written.filter(F.col(HOT) == hot).select(*df.columns)
    return Split(part(False), part(True), slices(hot_rows), hot_keys)


def _union(parts: Sequence[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, [part for part in parts if part is not None])


def sorted_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int
) -> DataFrame:
    """``df`` written in ranges of (keys, order), each row tagged with its range as ``_slice``.

    Ranges are cut on the full sort key, so a huge group spans many of them. Writing the table
    fixes the tags: range bounds come from sampling and would differ if computed again.
    """
    ranged = df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    return materialize(ranged, "slices")


def slice_offsets(sliced: DataFrame, keys: Sequence[str], weight: Column | None = None):
    """Per (keys, slice): weight inside it (``_inside``) and before it (``_before``).

    A slice border is crossed by one group at most, so groups here are as long as there are
    slices, not rows.
    """
    inside = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per_slice = sliced.groupBy(*keys, "_slice").agg(inside.alias("_inside"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return per_slice.withColumn("_before", F.coalesce(F.sum("_inside").over(earlier), F.lit(0)))


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    include_current: bool = True,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add window columns over each row and the ``before`` rows ahead of it in its group.

    ``columns`` maps output names to functions of the window. Rows that ``order`` leaves equal stand in the
    order of a hash of the whole row, so both plans and all runs see the same neighbours. Slices of an
    oversized group borrow the ``before`` rows that precede them, so their windows see what a window over
    the whole group would.
    """
    frame = (-before, 0 if include_current else -1)
    df, order = with_tie(df), [*order, TIE]

    def with_columns(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*groups).orderBy(*order).rowsBetween(*frame)
        return rows.withColumns({name: make(window) for name, make in columns.items()})

    split = split_hot(df, keys, max_group_rows)
    hot = split.hot
    result_cold = with_columns(split.cold, keys) if split.cold is not None else None
    if hot is None:
        return result_cold.drop(TIE)

    sliced = sorted_slices(hot, keys, order, split.slices)
    offsets = slice_offsets(sliced, keys)
    groups = [*keys, "_slice"]
    # Ranks wanted by each slice: the last `before` ranks of what lies ahead of it.
    wanted = offsets.filter(F.col("_before") > 0).select(
        *keys,
        F.col("_slice").alias("_target"),
        F.explode(
            F.sequence(F.greatest(F.col("_before") - (before - 1), F.lit(1)), F.col("_before"))
        ).alias("_rank"),
    )
    last_first = Window.partitionBy(*groups).orderBy(*[F.desc(c) for c in order])
    tails = sliced.withColumn("_from_end", F.row_number().over(last_first)).filter(
        F.col("_from_end") <= before
    )
    ranked = null_safe_join(tails, offsets, groups, "inner").withColumn(
        "_rank", F.col("_before") + F.col("_inside") - F.col("_from_end") + 1
    )
    borrowed = null_safe_join(ranked, wanted, [*keys, "_rank"], "inner").select(
        *hot.columns, F.col("_target").alias("_slice"), F.lit(True).alias("_borrowed")
    )
    own = sliced.withColumn("_borrowed", F.lit(False))
    result_hot = (
        with_columns(own.unionByName(borrowed), groups)
        .filter(~F.col("_borrowed"))
        .drop("_slice", "_borrowed")
    )
    return _union([result_cold, result_hot]).drop(TIE)


def running_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, equal ones by a hash of the row."""
    columns, df, order = df.columns, with_tie(df), [*order, TIE]
    split = split_hot(df, keys, max_group_rows)

    def place(groups: Sequence[str]) -> Column:
        window = Window.partitionBy(*groups).orderBy(*order)
        return F.row_number().over(window).cast("bigint")

    parts = []
    if split.cold is not None:
        parts.append(split.cold.withColumn(out, place(keys)))
    if split.hot is not None:
        groups = [*keys, "_slice"]
        sliced = sorted_slices(split.hot, keys, order, split.slices)
        numbered = null_safe_join(
            sliced.withColumn("_place", place(groups)), slice_offsets(sliced, keys), groups, "inner"
        )
        number = F.col("_before") + F.col("_place")
        parts.append(numbered.withColumn(out, number).select(*df.columns, out))
    return _union(parts).select(*columns, out)


def _hot_medians(split: Split, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact medians of oversized groups by rank, from sorted slices of (value, copies)."""
    copies = (
        split.hot.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    sliced = sorted_slices(copies, keys, [value], split.slices)
    offsets = slice_offsets(sliced, keys, F.col("_copies"))
    totals = offsets.groupBy(*keys).agg(F.sum("_inside").alias("_n"))
    middle = totals.select(
        *keys,
        F.explode(
            F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)).cast("array<bigint>")
        ).alias("_wanted"),
    )
    # Two ranks per hot group.
    target = null_safe_join(offsets, middle, keys, "inner").filter(
        (F.col("_before") <= F.col("_wanted"))
        & (F.col("_wanted") < F.col("_before") + F.col("_inside"))
    )
    groups = [*keys, "_slice"]
    running = Window.partitionBy(*groups).orderBy(value)
    candidates = null_safe_join(
        sliced, target.select(*groups).distinct(), groups, "left_semi"
    ).withColumn("_upto", F.sum("_copies").over(running))
    hits = null_safe_join(candidates, target.select(*groups, "_before", "_wanted"), groups, "inner")
    inside = F.col("_wanted") - F.col("_before")
    medians = (
        hits.filter((inside < F.col("_upto")) & (inside >= F.col("_upto") - F.col("_copies")))
        .groupBy(*keys)
        .agg(F.avg(value).alias(out))
    )
    if not keys:
        return medians
    # A group without any value keeps its row.
    return null_safe_join(split.hot_keys, medians, keys, "left")


def group_medians(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str = "median",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact median per group, nulls ignored. Values must not be NaN."""
    split = split_hot(df, keys, max_group_rows)
    parts = []
    if split.cold is not None:
        parts.append(split.cold.groupBy(*keys).agg(F.median(value).alias(out)))
    if split.hot is not None:
        parts.append(_hot_medians(split, keys, value, out))
    return _union(parts)


def long_frame_stats(
    df: DataFrame, keys: Sequence[str], value: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Background statistics of images given one pixel per row: the long form of
    ``frame_stats`` for images too large for one row.

    Ordinary images take one shuffle: every window and the aggregate use the same keys.
    Oversized ones never gather in a task; their level and threshold are joined to the pixels, one
    row per oversized image. Their pixels are written once, as five passes read them.
    """
    pixels = df.select(*keys, mask_non_finite(F.col(value).cast("double")).alias("_v"))
    split = split_hot(pixels, keys, max_group_rows)

    def summary(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.count("_v").cast("int").alias("n_valid"),
            F.max("median_bg").alias("median_bg"),
            F.max("mean_sub").alias("mean_sub"),
            F.max("std_sub").alias("std_sub"),
            F.count(F.when(F.col("_sub") > F.col("mean_sub") + F.col("std_sub") * 3.0, 1))
            .cast("int").alias("bright_pixels"),
        )

    parts = []
    if split.cold is not None:
        group = Window.partitionBy(*keys)
        rows = split.cold.withColumn("median_bg", F.median("_v").over(group))
        rows = rows.withColumn("_sub", F.col("_v") - F.col("median_bg"))
        rows = rows.withColumns(
            {"mean_sub": F.avg("_sub").over(group), "std_sub": F.stddev_pop("_sub").over(group)}
        )
        parts.append(summary(rows))
    if split.hot is not None:
        split = replace(split, hot=materialize(split.hot, "hot-pixels"))
        level = materialize(_hot_medians(split, keys, "_v", "median_bg"), "hot-levels")
        rows = null_safe_join(split.hot, level, keys, "left").withColumn(
            "_sub", F.col("_v") - F.col("median_bg")
        )
        moments = materialize(
            rows.groupBy(*keys).agg(
                F.avg("_sub").alias("mean_sub"), F.stddev_pop("_sub").alias("std_sub")
            ),
            "hot-moments",
        )
        parts.append(summary(null_safe_join(rows, moments, keys, "left")))
    return _union(parts)
