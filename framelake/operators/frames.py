"""Image operators on frame rows: one image per row, pixels in an array column.

Every operator here is row-local. Stages (``pixels.stage``) keep each sorted array computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelake.functions import naming, pixels as px
from framelake.functions.measures import as_column, is_finite

# Fixed values.
SUCCESS = "SUCCESS"
NO_IMAGE = "ERR:NoImageData"
ALL_NAN = "ERR:AllNaN"
SATURATION_LEVEL = 65000.0
#: Characters of an error text in a feature row.
ERROR_TEXT = 20


def pixel_explode(
    frames: DataFrame, keys: Sequence[str], pixels: str, width: Column | str | int
) -> DataFrame:
    """One row per pixel: keys, y, x, v."""
    width = F.lit(width) if isinstance(width, int) else as_column(width)
    return (
        frames.select(*keys, width.alias("_w"), F.posexplode(px.as_doubles(pixels)))
        .select(
            *keys,
            F.floor(F.col("pos") / F.col("_w")).cast("int").alias("y"),
            F.pmod("pos", "_w").cast("int").alias("x"),
            F.col("col").alias("v"),
        )
    )


def with_valid(frames: DataFrame, pixels: str) -> DataFrame:
    """Add ``_sorted``, the finite pixels in rising order."""
    return px.stage(frames, {"_sorted": px.valid_sorted(pixels)})


def frame_median(frames: DataFrame, pixels: str, out: str = "median_bg") -> DataFrame:
    return with_valid(frames, pixels).withColumn(out, px.median_of_sorted("_sorted")).drop("_sorted")


def background_subtract(frames: DataFrame, pixels: str, out: str = "subtracted") -> DataFrame:
    """Pixels minus the median of the finite ones; non-finite pixels become null."""
    leveled = frame_median(frames, pixels, "_level")
    level = F.col("_level")
    return leveled.withColumn(
        out, F.transform(px.as_doubles(pixels), lambda v: F.when(is_finite(v), v - level))
    ).drop("_level")


def frame_stats(frames: DataFrame, pixels: str) -> DataFrame:
    """Add n_valid, median_bg, mean_sub, std_sub and bright_pixels, and drop the pixels.

    Statistics are of the pixels minus their median; the deviation is of the population; bright
    pixels lie strictly above mean + 3 deviations.
    """
    staged = with_valid(frames, pixels).drop(pixels)
    staged = px.stage(staged, {
        "n_valid": F.greatest(F.size("_sorted"), F.lit(0)), "median_bg": px.median_of_sorted("_sorted"),
    })
    staged = px.stage(staged, {"_sub": px.subtract("_sorted", "median_bg")}).drop("_sorted")
    staged = px.stage(staged, {"mean_sub": px.mean("_sub")})
    staged = px.stage(staged, {"std_sub": px.std_population("_sub", "mean_sub")})
    bright = px.count_above("_sub", F.col("mean_sub") + F.col("std_sub") * 3.0)
    return px.stage(staged, {"bright_pixels": F.when(F.col("n_valid") > 0, bright)}).drop("_sub")


def pixel_status(n_pixels: Column | str, n_valid: Column | str) -> Column:
    n_pixels, n_valid = as_column(n_pixels), as_column(n_valid)
    return (
        F.when(F.coalesce(n_pixels, F.lit(0)) <= 0, NO_IMAGE)
        .when(n_valid <= 0, ALL_NAN)
        .otherwise(SUCCESS)
    )


def bronze_features(
    frames: DataFrame, path: str, pixels: str, status: str | None = None
) -> DataFrame:
    """One feature row per image. A failed image is a row with a status and no statistics.

    ``status`` names a column that is already set for images that could not be decoded; those
    keep it and lose their type.
    """
    decode_status = F.col(status) if status else F.lit(None).cast("string")
    stats = frame_stats(
        frames.select(
            F.col(path).alias("file_path"),
            F.col(pixels).alias("_pixels"),
            F.size(F.col(pixels)).alias("_n_pixels"),
            decode_status.alias("_decoded"),
        ),
        "_pixels",
    )
    return bronze_rows(stats.withColumnsRenamed({"_decoded": "status", "_n_pixels": "n_pixels"}), "file_path")


def bronze_rows(stats: DataFrame, path: str) -> DataFrame:
    """Feature rows from the statistics of images: n_pixels, n_valid, median_bg, mean_sub, std_sub,
    bright_pixels and status, null where nothing is known yet."""
    failed = F.coalesce((F.col("status") != SUCCESS) & (F.col("status") != NO_IMAGE) & (F.col("status") != ALL_NAN), F.lit(False))
    return stats.withColumns({"_failed": failed, "file_path": F.col(path)}).select(
        "file_path",
        naming.object_id("file_path").alias("object_id"),
        F.when(F.col("_failed"), naming.UNKNOWN)
        .otherwise(naming.image_type("file_path")).alias("image_type"),
        "median_bg",
        "mean_sub",
        "std_sub",
        "bright_pixels",
        F.when(F.col("_failed"), F.left("status", F.lit(len("ERR:") + ERROR_TEXT)))
        .otherwise(pixel_status("n_pixels", "n_valid")).alias("status"),
    )


def frame_stats_lines(bronze: DataFrame) -> DataFrame:
    """path, mean, std and, in one text column, the bright count or the error."""
    return bronze.select(
        F.col("file_path").alias("path"),
        "mean_sub",
        "std_sub",
        F.when(F.col("status") == SUCCESS, F.col("bright_pixels").cast("string"))
        .otherwise(F.col("status")).alias("bright_or_error"),
    )


def background_noise(frames: DataFrame, pixels: str) -> DataFrame:
    """Add n_valid, background_level and background_noise; keeps ``_sorted`` and the pixels."""
    staged = with_valid(frames, pixels)
    staged = px.stage(staged, {
        "n_valid": F.greatest(F.size("_sorted"), F.lit(0)), "background_level": px.median_of_sorted("_sorted"),
    })
    staged = px.stage(staged, {"_deviations": px.deviations("_sorted", "background_level")})
    return px.stage(staged, {"background_noise": px.noise("_deviations")}).drop("_deviations")


def mad_noise(frames: DataFrame, pixels: str) -> DataFrame:
    return background_noise(frames, pixels).drop("_sorted", pixels)


def dynamic_range(frames: DataFrame, pixels: str, out: str = "dynamic_range") -> DataFrame:
    staged = with_valid(frames, pixels)
    return staged.withColumn(out, px.span_of_sorted("_sorted")).drop("_sorted", pixels)


def saturation_fraction(
    frames: DataFrame, pixels: str, level: float = SATURATION_LEVEL,
    out: str = "saturation_fraction",
) -> DataFrame:
    staged = with_valid(frames, pixels)
    return staged.withColumn(out, px.share_at_least("_sorted", level)).drop("_sorted", pixels)


def hot_pixels(frames: DataFrame, pixels: str, sigma: float) -> DataFrame:
    """Add ``_hot``, the indexes of pixels more than ``sigma`` noise units above background.

    Without a positive noise there are none. Expects the columns of ``background_noise``.
    """
    threshold = F.when(F.col("background_noise") > 0, F.col("background_noise") * float(sigma))
    return px.stage(frames, {"_hot": px.positions_above(pixels, "background_level", threshold)})


def sigma_mask(
    frames: DataFrame, keys: Sequence[str], pixels: str, width: Column | str | int, sigma: float = 5.0
) -> DataFrame:
    """One row per pixel above the noise threshold: keys, y, x, value above background."""
    width = F.lit(width) if isinstance(width, int) else as_column(width)
    marked = hot_pixels(background_noise(frames.withColumn("_w", width), pixels), pixels, sigma)
    marked = marked.withColumn("_above", px.values_at(pixels, "_hot", "background_level"))
    return marked.select(
        *keys, "_w", F.inline(F.arrays_zip(F.col("_hot").alias("pos"), F.col("_above").alias("above")))
    ).select(
        *keys,
        F.floor(F.col("pos") / F.col("_w")).cast("int").alias("y"),
        F.pmod("pos", "_w").cast("int").alias("x"),
        "above",
    )


def plain_stats(frames: DataFrame, sample: str) -> DataFrame:
    """mean, std and count above mean + 3 deviations of the finite values of ``sample``."""
    staged = with_valid(frames, sample).drop(sample)
    staged = px.stage(staged, {"mean_value": F.coalesce(px.mean("_sorted"), F.lit(0.0))})
    staged = px.stage(
        staged, {"std_value": F.coalesce(px.std_population("_sorted", "mean_value"), F.lit(0.0))}
    )
    above = px.count_above("_sorted", F.col("mean_value") + F.col("std_value") * 3.0)
    return px.stage(staged, {"num_objects": F.greatest(above, F.lit(0))}).drop("_sorted")


def light_stats(frames: DataFrame, pixels: str) -> DataFrame:
    """Statistics of the raw finite pixels, without background subtraction."""
    return plain_stats(frames, pixels)


#: Hashes that order a draw lie below this.
HASHES = 1 << 40


def pixel_hash(*columns: Column) -> Column:
    """Place in the draw of a pixel with these keys, index and seed, below ``HASHES``."""
    return F.pmod(F.xxhash64(*columns), F.lit(HASHES))


def _sampled_pixels(pixels: str, keys: Sequence[str], sample: int, seed: int,
                    hashed: Callable[..., Column] = pixel_hash) -> Column:
    """The ``sample`` pixels with the smallest hashes.

    Only pixels below a hash bound that lets slightly more than ``sample`` through are sorted. In
    the rare case that too few pass, all are, so the draw is always the same.
    """
    values = F.col(pixels)
    key = [F.col(k) for k in keys]
    share = (sample + 8.0 * sample**0.5 + 8.0) / F.size(values)
    bound = F.least(share, F.lit(1.0)) * float(HASHES)

    def drawn(limit: Column) -> Column:
        def tag(v: Column, i: Column) -> Column:
            h = hashed(*key, i, F.lit(seed))
            return F.when(h < limit, F.struct(h.alias("h"), i.alias("i"), v.alias("v")))

        return F.array_compact(F.transform(values, tag))

    # A one-element array binds the candidates to a name, so they are built once.
    chosen = F.get(
        F.transform(
            F.array(drawn(bound)),
            lambda few: F.when(F.size(few) >= sample, few).otherwise(drawn(F.lit(float(HASHES)))),
        ),
        0,
    )
    picked = F.transform(F.slice(F.array_sort(chosen), 1, sample), lambda t: t["v"])
    return F.when(F.size(values) > sample, picked).otherwise(values)


def draw_pixels(
    frames: DataFrame, pixels: str, keys: Sequence[str], sample: int, seed: int = 0,
    hashed: Callable[..., Column] = pixel_hash,
) -> DataFrame:
    """``frames`` with ``sample`` of their pixels, drawn as ``sampled_stats`` draws them."""
    return px.stage(frames, {pixels: _sampled_pixels(pixels, keys, sample, seed, hashed)})


def sampled_stats(
    frames: DataFrame, pixels: str, keys: Sequence[str], sample: int, seed: int = 0,
    hashed: Callable[..., Column] = pixel_hash,
) -> DataFrame:
    """``light_stats`` of pixels drawn without replacement, the count scaled to the image.

    The draw orders pixels by a hash of key, index and seed, so it is repeatable; ``hashed`` may be another
    function of them with values below ``HASHES``. Images of ``sample`` pixels or fewer are used whole.
    """
    staged = draw_pixels(frames.withColumn("_n", F.size(pixels)), pixels, keys, sample, seed, hashed)
    return scaled_count(plain_stats(staged, pixels), sample).drop("_n")


def scaled_count(stats: DataFrame, sample: int) -> DataFrame:
    """``num_objects`` of a sample scaled to the ``_n`` pixels of the image, and cut to a whole number."""
    scale = F.try_divide(F.col("_n"), F.least(F.col("_n"), F.lit(sample)))
    return stats.withColumn(
        "num_objects", F.coalesce((F.col("num_objects") * scale).cast("int"), F.lit(0))
    )


def light_or_sampled(
    frames: DataFrame, pixels: str, keys: Sequence[str], pressure: Column | float,
    sample: int, low_pressure: float, seed: int = 0, hashed: Callable[..., Column] = pixel_hash,
) -> DataFrame:
    """Whole images where the resource pressure is below ``low_pressure``, sampled ones otherwise."""
    pressure = pressure if isinstance(pressure, Column) else F.lit(float(pressure))
    whole = pressure < low_pressure
    chosen = F.when(whole, F.col(pixels)).otherwise(
        _sampled_pixels(pixels, keys, sample, seed, hashed)
    )
    staged = frames.withColumn("_n", F.size(pixels)).withColumn("_whole", whole)
    staged = plain_stats(staged.withColumn(pixels, chosen), pixels)
    scale = F.when(F.col("_whole"), 1.0).otherwise(
        F.try_divide(F.col("_n"), F.least(F.col("_n"), F.lit(sample)))
    )
    return staged.withColumn(
        "num_objects", F.coalesce((F.col("num_objects") * scale).cast("int"), F.lit(0))
    ).withColumn("mode", F.when(F.col("_whole"), "light").otherwise("sampled")).drop("_n", "_whole")
