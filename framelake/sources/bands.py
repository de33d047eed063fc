"""Images too large for one row, read in bands of rows.

A first stage opens each file, walks its headers and finds where the first unit with pixels lies. Bands of
``band_bytes`` are then dealt to tasks, and each task reads its bands only, from their place in the file.
A band is a row that holds whole lines of the image; ``band_pixels`` makes pixel rows of them, which the
long forms of the statistics and the labelling take.

A gzipped file cannot be read from the middle: one task streams it and hands out its bands one after the
other. A file that cannot be read, has no pixels or ends early is one row with a status.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from framelake.operators.frames import NO_IMAGE, SUCCESS
from framelake.schemas import BIGINT, FLOAT, INT, STRING, struct
from framelake.sources.images import BLOCK, GZIP_MAGIC, PIXEL_TYPES, header_values, image_shape, scaled
from framelake.sources.manifest import opened

#: Bytes of pixels in a band; a band has one line of the image at least.
BAND_BYTES = 8 << 20

#: Where an image's pixels lie: one row per file.
LAYOUT = struct(path=STRING, height=INT, width=INT, offset=BIGINT, gzipped=T.BooleanType(), header=STRING, status=STRING)
#: Lines ``y`` to ``y + lines - 1`` of an image, row-major.
BAND = struct(frame_id=STRING, height=INT, width=INT, y=INT, lines=INT, pixels=T.ArrayType(FLOAT), status=STRING)

_LAYOUT_ARROW = pa.schema([
    ("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("offset", pa.int64()),
    ("gzipped", pa.bool_()), ("header", pa.string()), ("status", pa.string()),
])
_BAND_ARROW = pa.schema([
    ("frame_id", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("y", pa.int32()),
    ("lines", pa.int32()), ("pixels", pa.list_(pa.float32())), ("status", pa.string()),
])


class _Inflated:
    """A gzip stream of any number of members, read forward and skipped forward."""

    def __init__(self, stream):
        self.stream, self.members, self.ready, self.at = stream, zlib.decompressobj(31), b"", 0

    def read(self, n: int) -> bytes:
        parts, missing = [], n
        while missing:
            if not self.ready:
                waiting = self.members.unconsumed_tail
                if self.members.eof:  # another member, or padding
                    waiting = self.members.unused_data.lstrip(b"\0")
                    self.members = zlib.decompressobj(31)
                raw = waiting or self.stream.read(1 << 16)
                if not raw:
                    break
                self.ready = self.members.decompress(raw, 1 << 20)
                continue
            part, self.ready = self.ready[:missing], self.ready[missing:]
            parts.append(part)
            missing -= len(part)
        self.at += n - missing
        return b"".join(parts)

    def seek(self, place: int) -> None:
        while self.at < place and self.read(min(place - self.at, 1 << 20)):
            pass


def _open(path: str):
    """(stream that reads and seeks forward, whether it is compressed)."""
    system, inner, _ = opened(path)
    stream = system.open_input_file(inner)
    if stream.read(2) == GZIP_MAGIC:
        stream.seek(0)
        return _Inflated(stream), True
    stream.seek(0)
    return stream, False


def _locate(stream) -> tuple[dict[str, str], int] | None:
    """Header of the first unit with pixels, and where its pixels begin; None when no unit has any."""
    at, first = 0, True
    while True:
        stream.seek(at)
        block = stream.read(BLOCK)
        if first and not block.startswith(b"SIMPLE  ="):
            raise ValueError("not an image file")
        if block[:8] not in (b"SIMPLE  ", b"XTENSION"):
            return None
        header, at, ended = {}, at, False
        while not ended:
            if len(block) < BLOCK:
                raise ValueError("truncated header")
            ended = header_values(block, header)
            at += BLOCK
            block = b"" if ended else stream.read(BLOCK)
        shape, size, count = image_shape(header)
        if count:
            if "IMAGE" not in header.get("XTENSION", "IMAGE"):
                raise ValueError("unsupported unit")
            return header, at
        at, first = at + -(-size // BLOCK) * BLOCK, False


def _layout(path: str) -> tuple:
    try:
        stream, gzipped = _open(path)
        found = _locate(stream)
        if found is None:
            return path, 0, 0, None, gzipped, None, NO_IMAGE
        header, offset = found
        shape, _, count = image_shape(header)
        if not gzipped:
            size = count * abs(int(header["BITPIX"])) // 8
            stream.seek(0, io.SEEK_END)
            if stream.tell() < offset + size:
                raise ValueError("truncated data")
        return path, count // shape[0], shape[0], offset, gzipped, json.dumps(header), SUCCESS
    except Exception as error:  # whatever the bytes hold, the outcome is a status
        return path, 0, 0, None, None, None, f"ERR:{error}"


def layouts(files: DataFrame, path: str = "path") -> DataFrame:
    """Where the pixels of each file lie; reads headers only, one row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [_layout(name) for name in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _LAYOUT_ARROW)], schema=_LAYOUT_ARROW)

    return files.select(path).mapInArrow(run, LAYOUT)


def _bands_of(path: str, height: int, width: int, offset: int, header: str, first: int, lines: int,
              band_lines: int) -> Iterator[tuple]:
    """Bands of lines ``first`` to ``first + lines - 1``, in order."""
    values = json.loads(header)
    kind = np.dtype(PIXEL_TYPES[int(values["BITPIX"])])
    stream, _ = _open(path)
    stream.seek(offset + first * width * kind.itemsize)
    for y in range(first, first + lines, band_lines):
        n = min(band_lines, first + lines - y)
        data = stream.read(n * width * kind.itemsize)
        if len(data) < n * width * kind.itemsize:
            raise ValueError("truncated data")
        yield path, height, width, y, n, scaled(np.frombuffer(data, kind), values, width).ravel(), SUCCESS


def read_bands(files: DataFrame, path: str = "path", band_bytes: int = BAND_BYTES, tasks: int | None = None) -> DataFrame:
    """Bands of all images of ``files``, and one row with a status for each file without.

    Only the layouts travel: bands are numbered from them, dealt out evenly and read where they end up.
    """
    spark = files.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Four bytes a pixel, whatever the file holds.
    lines = F.greatest(F.lit(1), F.floor(F.lit(band_bytes // 4) / F.greatest("width", F.lit(1)))).cast("int")
    # A compressed image is one piece of work, any other as many as it has bands.
    step = F.when(F.col("gzipped"), F.greatest("height", F.lit(1))).otherwise(F.col("_lines"))
    starts = F.when(F.col("status") == SUCCESS, F.sequence(F.lit(0), F.col("height") - 1, F.col("_step"))).otherwise(F.array(F.lit(0)))
    work = layouts(files, path).withColumn("_lines", lines).withColumn("_step", step).select(
        "path", "height", "width", "offset", "header", "status", "_lines", "_step", F.explode(starts).alias("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, height, width = row["path"], row["height"], row["width"]
                if row["status"] != SUCCESS:
                    yield _row((name, 0, 0, None, 0, np.zeros(0, np.float32), row["status"]))
                    continue
                try:
                    for band in _bands_of(name, height, width, row["offset"], row["header"], row["_first"],
                                          min(row["_step"], height - row["_first"]), row["_lines"]):
                        yield _row(band)
                except Exception as error:
                    yield _row((name, height, width, None, 0, np.zeros(0, np.float32), f"ERR:{error}"))

    return work.repartition(tasks).mapInArrow(run, BAND)


def _row(band: tuple) -> pa.RecordBatch:
    name, height, width, y, lines, pixels, status = band
    values = pa.ListArray.from_arrays(pa.array([0, len(pixels)], pa.int32()), pa.array(pixels, pa.float32()))
    rest = [pa.array([v], f.type) for v, f in zip((name, height, width, y, lines), _BAND_ARROW)]
    return pa.RecordBatch.from_arrays([*rest, values, pa.array([status], pa.string())], schema=_BAND_ARROW)


def band_pixels(bands: DataFrame) -> DataFrame:
    """One row per pixel: frame_id, y, x, v. Bands without pixels give none."""
    return bands.select("frame_id", "width", F.col("y").alias("_y"), F.posexplode("pixels")).select(
        "frame_id",
        (F.col("_y") + F.floor(F.col("pos") / F.col("width"))).cast("int").alias("y"),
        F.pmod("pos", "width").cast("int").alias("x"),
        F.col("col").cast("double").alias("v"),
    )
