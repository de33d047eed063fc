"""Image bytes to frame rows, and alert packets to stamps.

A file that cannot be decoded becomes a row with a status, never a failed task.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from framelake import schemas
from framelake.operators.frames import ALL_NAN, NO_IMAGE, SUCCESS

# Fixed values of the public FITS layout.
BLOCK = 2880
CARD = 80
PIXEL_TYPES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
GZIP_MAGIC = b"\x1f\x8b"
CUTOUT_KINDS = ["Science", "Template", "Difference"]


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip stream; no bytes are no stream."""
    if not data:
        raise EOFError("empty stream")
    return gzip.decompress(data)


def header_values(block: bytes, values: dict[str, str]) -> bool:
    """Add the cards of a header block to ``values``, as text; whether the header ends in it."""
    for start in range(0, BLOCK, CARD):
        card = block[start : start + CARD].decode("ascii", "replace")
        name = card[:8].strip()
        if name == "END":
            return True
        if card[8:10] == "= ":
            values.setdefault(name, card[10:].split("/")[0].strip())
    return False


def _cards(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header values as text from ``at``, and where the data after the header starts."""
    values: dict[str, str] = {}
    while True:
        block = data[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("truncated header")
        at += BLOCK
        if header_values(block, values):
            return values, at


def image_shape(header: dict[str, str]) -> tuple[list[int], int, int]:
    """(axes, the first running fastest; bytes of the unit's data; pixels)."""
    axes = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header.get("NAXIS", "0")))]
    count = int(np.prod(axes)) if axes else 0
    groups = int(header.get("GCOUNT", "1"))
    return axes, groups * (count + int(header.get("PCOUNT", "0"))) * abs(int(header["BITPIX"])) // 8, count


def read_image(data: bytes) -> np.ndarray | None:
    """Pixels of the first unit that has any, as float32 rows; None when no unit has."""
    if data[:2] == GZIP_MAGIC:
        data = _gunzip(data)
    if not data.startswith(b"SIMPLE  ="):
        raise ValueError("not an image file")
    at = 0
    while at + CARD <= len(data) and data[at : at + 8] in (b"SIMPLE  ", b"XTENSION"):
        header, at = _cards(data, at)
        axes, size, count = image_shape(header)
        bits = int(header["BITPIX"])
        if count:
            if "IMAGE" not in header.get("XTENSION", "IMAGE"):
                raise ValueError("unsupported unit")
            if at + count * abs(bits) // 8 > len(data):
                raise ValueError("truncated data")
            return scaled(np.frombuffer(data, PIXEL_TYPES[bits], count, at), header, axes[0])
        at += -(-size // BLOCK) * BLOCK
    return None


def scaled(raw: np.ndarray, header: dict[str, str], width: int) -> np.ndarray:
    """Stored numbers as float32 lines of ``width`` pixels, by the header's scale, offset and blank."""
    number = lambda key, default: float(header.get(key, default).replace("D", "E"))
    scale, zero = number("BSCALE", "1"), number("BZERO", "0")
    values = raw.astype(np.float64) if (scale, zero) != (1.0, 0.0) else raw.astype(np.float32)
    if (scale, zero) != (1.0, 0.0):
        values = values * scale + zero
    if "BLANK" in header and raw.dtype.kind != "f":
        values[raw == int(header["BLANK"])] = np.nan
    return values.astype(np.float32).reshape(-1, width)


def decoded(content: bytes | None) -> tuple[np.ndarray | None, str]:
    """Pixels and status of a file's bytes."""
    try:
        image = read_image(content or b"")
    except Exception as error:  # whatever the bytes hold, the outcome is a status
        return None, f"ERR:{error}"
    if image is None:
        return None, NO_IMAGE
    return image, SUCCESS if np.isfinite(image).any() else ALL_NAN


def _frame_batch(rows: list[tuple[str, np.ndarray, str]]) -> pa.RecordBatch:
    paths, images, states = zip(*rows)
    offsets = np.concatenate(([0], np.cumsum([i.size for i in images]))).astype(np.int32)
    columns = [
        pa.array(paths, pa.string()),
        pa.array([i.shape[0] for i in images], pa.int32()),
        pa.array([i.shape[1] for i in images], pa.int32()),
        pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(np.concatenate([i.ravel() for i in images]))
        ),
        pa.array(states, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=schemas.FRAMES.fieldNames())


# An output batch is closed at this many pixels, so large images travel in small batches.
PIXELS_PER_BATCH = 4_000_000
ROWS_PER_BATCH = 1_000
NO_PIXELS = np.zeros((0, 0), np.float32)


def decode_frames(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files to frame rows, one for one. Gzipped content is recognised and inflated."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pixels = [], 0
            for name, content in zip(batch.column(0), batch.column(1)):
                image, status = decoded(content.as_py())
                rows.append((name.as_py(), NO_PIXELS if image is None else image, status))
                pixels += rows[-1][1].size
                if pixels >= PIXELS_PER_BATCH:
                    yield _frame_batch(rows)
                    rows, pixels = [], 0
            if rows:
                yield _frame_batch(rows)

    return files.select(path, content).mapInArrow(decode, schemas.FRAMES)


STATS = T.StructType([
    T.StructField("frame_id", T.StringType()), T.StructField("n_pixels", T.IntegerType()),
    T.StructField("n_valid", T.IntegerType()), T.StructField("median_bg", T.DoubleType()),
    T.StructField("mean_sub", T.DoubleType()), T.StructField("std_sub", T.DoubleType()),
    T.StructField("bright_pixels", T.IntegerType()), T.StructField("status", T.StringType()),
])


def _image_stats(image: np.ndarray | None) -> tuple:
    """n_pixels, n_valid, median, and mean, deviation and bright count of what is above it."""
    if image is None:
        return 0, 0, None, None, None, None
    values = image[np.isfinite(image)].astype(np.float64)
    if not values.size:
        return image.size, 0, None, None, None, None
    level = float(np.median(values))
    above = values - level
    mean, std = float(above.mean()), float(above.std())
    return image.size, values.size, level, mean, std, int((above > mean + 3.0 * std).sum())


def decode_stats(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files to background statistics, one for one, without passing pixels on."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0), batch.column(1)):
                image, status = decoded(data.as_py())
                rows.append((name.as_py(), *_image_stats(image), status))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 3, pa.int32(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=STATS.fieldNames())

    return files.select(path, content).mapInArrow(decode, STATS)


def map_files(files: DataFrame, function, schema: T.StructType, path: str = "path",
              content: str = "content") -> DataFrame:
    """User function over (path, bytes) pairs, an iterator in and an iterator of tuples out.

    It is called once per partition and sees all its files, whatever the batch size.
    """
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        pairs = ((p.as_py(), c.as_py()) for batch in batches for p, c in zip(batch.column(0), batch.column(1)))
        rows = (dict(zip(names, row)) for row in function(pairs))
        while some := list(islice(rows, ROWS_PER_BATCH)):
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return files.select(path, content).mapInArrow(run, schema)


def inflate_stamps(df: DataFrame, content: str = "content") -> DataFrame:
    """Gunzip a binary column; bytes that are no gzip stream become null."""

    @F.arrow_udf(T.BinaryType())
    def inflate(data: pa.Array) -> pa.Array:
        out = []
        for item in data:
            try:
                out.append(_gunzip(item.as_py()))
            except (TypeError, OSError, EOFError, zlib.error):
                out.append(None)
        return pa.array(out, pa.binary())

    return df.withColumn(content, inflate(F.col(content)))


def explode_cutouts(alerts: DataFrame) -> DataFrame:
    """Up to three rows per alert: candid, kind, file_name, content. Empty stamps are skipped.

    The id is candid, else alertId, a zero counting as absent. Alerts with neither get a negative
    hash of their stamps, which no real id can equal and which does not depend on the partitioning.
    """
    present = lambda column: F.when(F.col(column) != 0, F.col(column))
    stamps = F.array(
        *[
            F.struct(F.lit(k.lower()).alias("kind"), F.col(f"cutout{k}.stampData").alias("content"))
            for k in CUTOUT_KINDS
        ]
    )
    hashed = F.xxhash64(*[F.col(f"cutout{k}.stampData") for k in CUTOUT_KINDS])
    negative = F.when(hashed < 0, hashed).otherwise(-1 - hashed)
    named = alerts.withColumn("candid", F.coalesce(present("candid"), present("alertId"), negative))
    return (
        named.select("candid", F.inline(stamps))
        .filter(F.octet_length("content") > 0)
        .select(
            "candid",
            "kind",
            F.concat(F.col("candid").cast("string"), F.lit("_"), "kind", F.lit(".fits"))
            .alias("file_name"),
            "content",
        )
    )
