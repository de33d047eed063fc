"""Connected bright regions and their measures.

Pixels touch when they share a side or a corner. Two plans give the same sources:

* ``trace_sources`` works inside one row. Only the indexes and values of hot pixels reach
  Python, a whole batch of images at a time, and nothing is shuffled.
* ``label_pixels`` works on pixel rows. It labels tiles independently and merges labels that
  meet at tile borders, so one image may be larger than any task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framelake.functions import pixels as px
from framelake.functions.measures import as_column, magnitude
from framelake.operators.frames import background_noise, hot_pixels
from framelake.operators.skew import (
    MAX_GROUP_ROWS,
    null_safe_join,
    running_number,
    split_hot,
)
from framelake.workspace import materialize

# Fixed values.
DETECTION_SIGMA = 5.0
BRIGHT_SIGMA = 10.0

SOURCE = T.StructType(
    [
        T.StructField("label", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("flux_total", T.DoubleType()),
        T.StructField("flux_peak", T.DoubleType()),
        T.StructField("area_pixels", T.DoubleType()),
    ]
)


def smallest_members(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``count`` nodes the smallest node its edges connect it to."""
    roots = np.arange(count)
    while left.size:
        a, b = roots[left], roots[right]
        unequal = a != b
        left, right, a, b = left[unequal], right[unequal], a[unequal], b[unequal]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = roots[roots]
            if np.array_equal(shorter, roots):
                break
            roots = shorter
    return roots


def component_roots(nodes: np.ndarray, row_step: np.ndarray) -> np.ndarray:
    """For each node the index of the first node of its component.

    ``nodes`` are rising integers in which the right neighbour is +1 and the pixel below is
    ``+ row_step``; callers leave a gap between rows and images so that ends never touch.
    """
    if nodes.size < 2:
        return np.arange(nodes.size)
    sources, targets = [], []
    for step in (1, row_step - 1, row_step, row_step + 1):
        wanted = nodes + step
        at = np.minimum(np.searchsorted(nodes, wanted), nodes.size - 1)
        found = np.flatnonzero(nodes[at] == wanted)
        sources.append(found)
        targets.append(at[found])
    return smallest_members(nodes.size, np.concatenate(sources), np.concatenate(targets))


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenated values of a list column."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lengths.astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def trace_batch(positions: pa.Array, above: pa.Array, widths: pa.Array, floor: pa.Array) -> pa.Array:
    """Sources among the pixels above ``floor`` for a batch of images, in raster order."""
    lengths, index = _list_parts(positions)
    _, flux = _list_parts(above)
    images = np.repeat(np.arange(lengths.size), lengths)
    floors = floor.fill_null(np.inf).to_numpy(zero_copy_only=False)
    keep = flux > floors[images]
    images, index, flux = images[keep], index[keep].astype(np.int64), flux[keep]
    stride = widths.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    y, x = np.divmod(index, stride[images] - 2)
    # Each image gets its own stretch of node numbers, rows one gap apart.
    tall = np.zeros(lengths.size, np.int64)
    np.maximum.at(tall, images, y)
    start = np.concatenate(([0], np.cumsum((tall + 3) * stride)))[:-1]
    nodes = start[images] + y * stride[images] + x
    roots = component_roots(nodes, stride[images])
    first, member = np.unique(roots, return_inverse=True)
    count = first.size
    area = np.bincount(member, minlength=count).astype(np.float64)
    peak = np.full(count, -np.inf)
    np.maximum.at(peak, member, flux)
    owner = images[first] if count else np.zeros(0, np.int64)
    per_image = np.bincount(owner, minlength=lengths.size)
    offsets = np.concatenate(([0], np.cumsum(per_image))).astype(np.int32)
    label = np.arange(count) - offsets[owner] + 1
    total = lambda weights: np.bincount(member, weights=weights, minlength=count)
    sources = pa.StructArray.from_arrays(
        [
            pa.array(label.astype(np.int32)),
            pa.array(total(x) / np.maximum(area, 1)),
            pa.array(total(y) / np.maximum(area, 1)),
            pa.array(total(flux)),
            pa.array(peak),
            pa.array(area),
        ],
        names=SOURCE.fieldNames(),
    )
    return pa.ListArray.from_arrays(pa.array(offsets), sources)


def trace_sources(
    positions: Column | str, above: Column | str, width: Column | str, floor: Column | str
) -> Column:
    """Array of sources formed by the listed pixels whose value exceeds ``floor``."""

    @F.arrow_udf(T.ArrayType(SOURCE))
    def trace(p: pa.Array, a: pa.Array, w: pa.Array, f: pa.Array) -> pa.Array:
        return trace_batch(p, a, w, f)

    return trace(as_column(positions), as_column(above), as_column(width), as_column(floor))


def detect(
    frames: DataFrame,
    pixels: str,
    width: Column | str | int,
    detection_sigma: float = DETECTION_SIGMA,
    bright_sigma: float = BRIGHT_SIGMA,
    saturation_level: float | None = None,
) -> DataFrame:
    """Background, source counts and traced bright sources of every image.

    Adds n_valid, background_level, background_noise, ``_max`` (brightest pixel), dynamic_range,
    total_objects, bright_sources, faint_sources and ``sources``; with ``saturation_level`` also
    saturation_fraction. Drops the pixels. An image without positive noise has no sources. Faint
    is total minus bright and may be negative, when one faint region holds several bright ones.
    """
    width = F.lit(width) if isinstance(width, int) else as_column(width)
    staged = background_noise(frames.withColumn("_width", width), pixels)
    spans = {"_max": F.try_element_at("_sorted", F.lit(-1)), "dynamic_range": px.span_of_sorted("_sorted")}
    if saturation_level is not None:
        spans["saturation_fraction"] = px.share_at_least("_sorted", saturation_level)
    staged = px.stage(staged, spans).drop("_sorted")
    staged = hot_pixels(staged, pixels, min(detection_sigma, bright_sigma))
    staged = px.stage(staged, {"_above": px.values_at(pixels, "_hot", "background_level")}).drop(pixels)

    def traced(sigma: float) -> Column:
        return trace_sources("_hot", "_above", "_width", F.col("background_noise") * float(sigma))

    staged = px.stage(staged, {"_faintest": traced(detection_sigma), "sources": traced(bright_sigma)})
    staged = staged.withColumns(
        {"total_objects": F.size("_faintest"), "bright_sources": F.size("sources")}
    )
    return staged.withColumn(
        "faint_sources", F.col("total_objects") - F.col("bright_sources")
    ).drop("_hot", "_above", "_width", "_faintest")


def connected_sources(
    frames: DataFrame, pixels: str, width: Column | str | int, sigma: float = DETECTION_SIGMA
) -> DataFrame:
    """Add ``n_sources``, the number of connected regions above ``sigma`` noise units."""
    found = detect(frames, pixels, width, sigma, sigma)
    return found.withColumn("n_sources", F.col("total_objects")).drop(
        "n_valid", "background_level", "background_noise", "_max", "dynamic_range",
        "total_objects", "bright_sources", "faint_sources", "sources",
    )


def source_counts(
    frames: DataFrame, pixels: str, width: Column | str | int,
    detection_sigma: float = DETECTION_SIGMA, bright_sigma: float = BRIGHT_SIGMA,
) -> DataFrame:
    found = detect(frames, pixels, width, detection_sigma, bright_sigma)
    return found.drop(
        "n_valid", "background_level", "background_noise", "_max", "dynamic_range", "sources"
    )


def with_photometry(sources: DataFrame, noise: str = "background_noise") -> DataFrame:
    return sources.withColumns(
        {
            "magnitude_estimate": magnitude("flux_total"),
            "snr": F.when(F.col(noise) > 0, F.try_divide("flux_peak", noise)).otherwise(0.0),
        }
    )


def source_catalog(
    frames: DataFrame, keys: Sequence[str], pixels: str, width: Column | str | int,
    sigma: float = BRIGHT_SIGMA,
) -> DataFrame:
    """One row per bright source: position, flux, peak, area, magnitude and signal to noise."""
    found = detect(frames, pixels, width, sigma, sigma)
    rows = found.select(*keys, "background_noise", F.inline("sources"))
    return with_photometry(rows).drop("background_noise")


def source_lists(sources: Column | str, noise: Column | str, listed: int | None = None):
    """(positions, photometry) of the sources in raster order, as two arrays; all of them, or the
    first ``listed``."""
    kept = as_column(sources) if listed is None else F.slice(as_column(sources), 1, listed)
    noise = as_column(noise)
    positions = F.transform(kept, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    photometry = F.transform(
        kept,
        lambda s: F.struct(
            s["flux_total"].alias("flux_total"),
            s["flux_peak"].alias("flux_peak"),
            s["area_pixels"].alias("area_pixels"),
            magnitude(s["flux_total"]).alias("magnitude_estimate"),
            F.when(noise > 0, F.try_divide(s["flux_peak"], noise)).otherwise(0.0).alias("snr"),
        ),
    )
    return positions, photometry


# --- pixel rows -------------------------------------------------------------------------------

ROW_SHIFT = 32


def _node(y: Column, x: Column) -> Column:
    """Raster-ordered number of a pixel; needs no image width."""
    return F.shiftleft(y.cast("bigint"), ROW_SHIFT) + x.cast("bigint")


def _label_tile(tile: pa.Table) -> pa.Table:
    tile = tile.sort_by([("y", "ascending"), ("x", "ascending")])
    y = tile["y"].to_numpy().astype(np.int64)
    x = tile["x"].to_numpy().astype(np.int64)
    x0 = x.min()
    stride = np.full(y.size, x.max() - x0 + 3)
    roots = component_roots((y - y.min()) * stride + (x - x0), stride)
    names = (y << ROW_SHIFT) + x
    return tile.append_column("_part", pa.array(names[roots]))


def label_pixels(
    pixels: DataFrame, keys: Sequence[str], tile: int = 512, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add ``source``, the raster number of the first pixel of the region a pixel belongs to.

    ``pixels`` holds only the pixels of interest, each once, with int columns y and x. A task
    sees one tile of at most ``tile * tile`` pixels. Regions that cross borders are merged
    through the pairs of border pixels that touch, a graph much smaller than the image. The
    graph of an image is merged by one task, or, above ``max_group_rows`` pairs, in rounds of
    joins.
    """
    input_columns = pixels.columns
    with_tile = pixels.withColumns(
        {"_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int")}
    )
    schema = T.StructType(with_tile.schema.fields + [T.StructField("_part", T.LongType())])
    labeled = materialize(
        with_tile.groupBy(*keys, "_ty", "_tx").applyInArrow(_label_tile, schema), "tiles"
    )
    pairs = materialize(_touching_parts(labeled, keys, tile), "touching")
    split = split_hot(pairs, keys, max_group_rows)
    graphs = [_merge_by_image(split.cold, keys)] if split.cold is not None else []
    if split.hot is not None:
        graphs.append(_merge_in_rounds(split.hot, keys))
    merged = reduce(DataFrame.unionByName, graphs)
    named = null_safe_join(labeled, merged, [*keys, "_part"], "left")
    return named.select(*input_columns, F.coalesce("_root", "_part").alias("source"))


def _touching_parts(labeled: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Pairs of parts (``_part`` before ``_other``) with touching pixels in different tiles."""
    y, x = F.col("y"), F.col("x")
    on_border = (
        F.pmod(y, F.lit(tile)).isin(0, tile - 1) | F.pmod(x, F.lit(tile)).isin(0, tile - 1)
    )
    border = labeled.filter(on_border).select(
        *keys, "_ty", "_tx", "_part", "y", "x", _node(y, x).alias("_node")
    )
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                      for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    reaching = border.select("*", F.inline(steps)).filter(x + F.col("dx") >= 0).select(
        *keys, F.col("_ty").alias("_ty0"), F.col("_tx").alias("_tx0"), F.col("_part").alias("_from"),
        _node(y + F.col("dy"), x + F.col("dx")).alias("_node"),
    )
    pairs = null_safe_join(reaching, border.drop("y", "x"), [*keys, "_node"], "inner").filter(
        (F.col("_ty0") != F.col("_ty")) | (F.col("_tx0") != F.col("_tx"))
    )
    return pairs.select(
        *keys,
        F.least("_from", "_part").alias("_low"),
        F.greatest("_from", "_part").alias("_high"),
    ).distinct()


def _merge_by_image(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root of every part named in ``pairs``, one image at a time."""
    key_columns = list(keys)

    def merge(group: pa.Table) -> pa.Table:
        low, high = group["_low"].to_numpy(), group["_high"].to_numpy()
        parts, index = np.unique(np.concatenate([low, high]), return_inverse=True)
        roots = smallest_members(parts.size, index[: low.size], index[low.size :])
        out = group.select(key_columns).take(pa.array(np.zeros(parts.size, np.int64)))
        out = out.append_column("_part", pa.array(parts))
        return out.append_column("_root", pa.array(parts[roots]))

    fields = [pairs.schema[k] for k in key_columns]
    schema = T.StructType(
        fields + [T.StructField("_part", T.LongType()), T.StructField("_root", T.LongType())]
    )
    return pairs.groupBy(*key_columns).applyInArrow(merge, schema)


def _merge_in_rounds(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root of every part named in ``pairs``: the smallest part it is connected to.

    Star steps in turn: each part hangs its larger neighbours, then its smaller ones and itself, on
    the smallest part it touches. Rounds grow with the logarithm of a chain's length. Each writes
    its table, so lineage does not grow; the steps end when a round changes nothing.
    """
    links, before = pairs, None
    while True:
        links = materialize(_star(_star(links, keys, larger=True), keys, larger=False), "links")
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "_low", "_high").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    roots = links.select(*keys, F.col("_low").alias("_part")).distinct().withColumn("_root", F.col("_part"))
    return links.select(*keys, F.col("_high").alias("_part"), F.col("_low").alias("_root")).unionByName(roots)


def _star(links: DataFrame, keys: Sequence[str], larger: bool) -> DataFrame:
    both = links.unionByName(
        links.select(*keys, F.col("_high").alias("_low"), F.col("_low").alias("_high"))
    )
    wanted = both.filter("_high > _low" if larger else "_high < _low")
    least = (both if larger else wanted).groupBy(*keys, "_low").agg(F.min("_high").alias("_least"))
    least = least.select(*keys, "_low", F.least("_low", "_least").alias("_root"))
    hung = null_safe_join(wanted, least, [*keys, "_low"], "inner").select(*keys, "_root", "_high")
    if not larger:
        hung = hung.unionByName(least.select(*keys, "_root", F.col("_low").alias("_high")))
    return hung.filter("_root <> _high").select(*keys, F.col("_root").alias("_low"), "_high").distinct()


def measure_sources(
    labeled: DataFrame, keys: Sequence[str], above: str, source: str = "source"
) -> DataFrame:
    """Position, flux, peak and area per source of pixel rows; one partial aggregate."""
    return labeled.groupBy(*keys, source).agg(
        F.avg("x").alias("x"),
        F.avg("y").alias("y"),
        F.sum(above).alias("flux_total"),
        F.max(above).alias("flux_peak"),
        F.count(F.lit(1)).cast("double").alias("area_pixels"),
    )


def number_sources(sources: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Add ``label``, the place of a source in the raster order of its image.

    Images with more sources than one task should sort are numbered slice by slice.
    """
    return running_number(sources, keys, [source], "label")
