"""Exact medians and repeatable samples of images given as pixel rows, whatever their size.

Medians are found by narrowing: a number becomes a key whose order as a long is that of the numbers, the
leading ``BITS`` bits of all keys are counted, the bucket that holds the wanted rank is kept, and the next
bits are counted within it. Four rounds give the key itself. Counts combine where the pixels are, so a
round shuffles buckets, never pixels, and nothing is sorted but the buckets of a group.

Samples are the pixels of the smallest hashes. Each task keeps the smallest of what it sees, which merge
into the smallest of all by one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framelake.functions.measures import MAD_TO_SIGMA, as_column, mask_non_finite
from framelake.operators.frames import pixel_hash, plain_stats, scaled_count
from framelake.operators.history import top_k_per_group
from framelake.operators.skew import null_safe_join
from framelake.workspace import materialize

#: Bits that a round decides, of the 64 of a key.
BITS, KEY_BITS = 16, 64
#: Rows, in samples, that a task holds before it first drops what cannot be drawn, and rows that it keeps at most.
SLACK, HELD = 4, 1 << 20
_REST = np.int64(0x7FFF_FFFF_FFFF_FFFF)


def _turned(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as longs of the same order, and back: negative numbers count downwards."""
    return bits ^ ((bits >> np.int64(63)) & _REST)


def ordered_key(value: Column | str) -> Column:
    """A long per finite double, in the same order; both zeros have one key. Null stays null."""

    @F.arrow_udf(T.LongType())
    def key(values: pa.Array) -> pa.Array:
        numbers = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        return pa.array(_turned(numbers.view(np.int64)), mask=values.is_null().to_numpy(zero_copy_only=False))

    return key(as_column(value))


def key_value(key: Column | str) -> Column:
    """The double that a key stands for."""

    @F.arrow_udf(T.DoubleType())
    def value(keys: pa.Array) -> pa.Array:
        numbers = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(_turned(numbers).view(np.float64), mask=keys.is_null().to_numpy(zero_copy_only=False))

    return value(as_column(key))


def select_ranks(keyed: DataFrame, keys: Sequence[str], ranks: DataFrame) -> DataFrame:
    """(keys, ``_target``, ``_key``): the key of each wanted rank.

    ``keyed`` is a written table of keys and ``_key``. ``ranks`` has, for some or all groups, rows of
    ``_target`` and the rank, counted from 0.
    """
    wanted = materialize(ranks.select(*keys, "_target", F.col("_target").alias("_rank")), "ranks")
    groups = list(keys)
    for shift in range(KEY_BITS - BITS, -1, -BITS):
        bucket = F.shiftright("_key", shift).alias("_bucket")
        if groups == list(keys):
            counted = keyed.select(*keys, bucket)
        else:
            prefixes = wanted.select(*groups).distinct()
            inside = keyed.withColumn("_prefix", F.shiftright("_key", shift + BITS))
            counted = null_safe_join(inside, prefixes, groups, "left_semi").select(*groups, bucket)
        counts = counted.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        # At most 2**BITS buckets a group and rank.
        running = Window.partitionBy(*keys, "_target").orderBy("_bucket")
        upto = null_safe_join(wanted, counts, groups, "inner").withColumn("_upto", F.sum("_n").over(running))
        place = F.col("_rank") - (F.col("_upto") - F.col("_n"))
        wanted = materialize(
            upto.filter((place >= 0) & (place < F.col("_n"))).select(
                *keys, "_target", place.alias("_rank"), F.col("_bucket").alias("_prefix")), "narrowed")
        groups = [*keys, "_prefix"]
    return wanted.select(*keys, "_target", F.col("_prefix").alias("_key"))


def exact_medians(df: DataFrame, keys: Sequence[str], value: str | Column, out: str = "median",
                  count: str = "n_valid") -> DataFrame:
    """Per group the number of finite values and their median; null where a group has none."""
    keyed = materialize(df.select(*keys, ordered_key(mask_non_finite(as_column(value).cast("double"))).alias("_key")), "keys")
    sizes = materialize(keyed.groupBy(*keys).agg(F.count("_key").alias(count)), "group-sizes")
    n = F.col(count)
    ranks = sizes.filter(n > 0).select(
        *keys, F.explode(F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)))).alias("_target"))
    found = select_ranks(keyed.filter(F.col("_key").isNotNull()), keys, ranks)
    medians = found.withColumn("_value", key_value("_key")).groupBy(*keys).agg(F.avg("_value").alias(out))
    return null_safe_join(sizes, medians, keys, "left")


def background_noise_long(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per image of pixel rows: n_valid, background_level and background_noise."""
    levels = materialize(exact_medians(df, keys, value, "background_level"), "levels")
    # One row per image: Spark sends it to all tasks when its written size is small.
    leveled = null_safe_join(df.select(*keys, F.col(value).alias("_v")), levels, keys, "inner")
    deviation = F.abs(F.col("_v").cast("double") - F.col("background_level"))
    spread = exact_medians(leveled, keys, deviation, "_spread", "_n").drop("_n")
    noise = null_safe_join(levels, spread, keys, "left")
    return noise.withColumn("background_noise", F.col("_spread") * MAD_TO_SIGMA).drop("_spread")


def _smallest(keys: Sequence[str], sample: int):
    """A function over Arrow batches of (keys, ``_h``, ``_i``, ``_v``): the ``sample`` rows of least (h, i) of each
    group that a task sees."""
    order = [*[(k, "ascending") for k in keys], ("_h", "ascending"), ("_i", "ascending")]

    def kept(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).combine_chunks()
        if not table.num_rows:
            return table
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            column = table.column(k).combine_chunks()
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        place = np.arange(table.num_rows) - np.repeat(starts, np.diff(np.append(starts, table.num_rows)))
        return table.filter(pa.array(place < sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, SLACK * sample
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                table = kept(pa.Table.from_batches(held))
                held, rows = table.to_batches(), table.num_rows
                if rows > HELD:  # very many images: hand over what is left of them and begin again
                    yield from held
                    held, rows = [], 0
                limit = max(SLACK * sample, 2 * rows)
        if held:
            yield from kept(pa.Table.from_batches(held)).to_batches()

    return run


def draw_long(df: DataFrame, keys: Sequence[str], position: str, value: str, sample: int, seed: int = 0,
              hashed: Callable[..., Column] = pixel_hash) -> DataFrame:
    """keys, ``_n`` and the array ``_drawn``: the ``sample`` pixels that ``frames.draw_pixels`` draws.

    ``position`` is a pixel's place in its image, row-major from 0.
    """
    # The row form hashes the same columns of the same types.
    place = hashed(*[F.col(k) for k in keys], F.col(position).cast("int"), F.lit(seed))
    rows = df.select(*keys, place.alias("_h"), F.col(position).cast("int").alias("_i"), F.col(value).cast("double").alias("_v"))
    few = rows.mapInArrow(_smallest(keys, sample), rows.schema)
    drawn = top_k_per_group(few, keys, ["_h", "_i"], sample, "_rank")
    # At most ``sample`` pixels an image.
    taken = F.sort_array(F.collect_list(F.struct("_h", "_i", "_v")))
    arrays = drawn.groupBy(*keys).agg(F.transform(taken, lambda p: p["_v"]).alias("_drawn"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return null_safe_join(sizes, arrays, keys, "inner")


def sampled_stats_long(df: DataFrame, keys: Sequence[str], position: str, value: str, sample: int, seed: int = 0,
                       hashed: Callable[..., Column] = pixel_hash) -> DataFrame:
    """``frames.sampled_stats`` of images given as pixel rows."""
    drawn = draw_long(df, keys, position, value, sample, seed, hashed)
    return scaled_count(plain_stats(drawn, "_drawn"), sample).drop("_n")
