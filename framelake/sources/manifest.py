"""Listings of very many files as tables, and reading the listed files in tasks of equal size.

Spark's file sources keep the status of every file on the driver. For billions of small images that
does not fit, so here folders are listed by tasks, level by level, into a manifest table, and the files
of a manifest are read by tasks. The driver knows the number of levels and of tasks only. Paths are
opened with ``pyarrow.fs``: local paths, and the remote stores that it is built for.
"""

from __future__ import annotations

import posixpath
import urllib.parse
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from framelake import schemas
from framelake.operators.frames import SUCCESS
from framelake.schemas import BIGINT, STRING, struct
from framelake.workspace import materialize

#: One row per file, and one per folder or path that could not be listed, with the reason as status.
MANIFEST = struct(path=STRING, length=BIGINT, modificationTime=T.TimestampType(), status=STRING)
#: Manifest columns, the file's bytes, null where ``status`` says why.
READ_FILES = struct(**{f.name: f.dataType for f in schemas.RAW_FILES}, status=STRING)

_ENTRY = schemas.with_fields(MANIFEST, kind=STRING)
_ENTRY_ARROW = pa.schema([
    ("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC")),
    ("status", pa.string()), ("kind", pa.string()),
])
_READ_ARROW = pa.schema([
    ("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()),
    ("content", pa.binary()), ("status", pa.string()),
])
FILE, FOLDER, FAILED = "file", "folder", "failed"
#: Entries of a listing, and bytes of files, that a task hands over at a time.
ENTRIES_PER_BATCH, BYTES_PER_BATCH = 10_000, 16 << 20
#: Bytes of files per task, and what opening a file costs on top of its bytes.
BYTES_PER_TASK, OPEN_COST = 128 << 20, 64 << 10
#: A binary value ends below two gibibytes; larger images are read in bands.
LARGEST_ROW = (1 << 31) - (1 << 20)
ERROR_TEXT = 200


def opened(path: str) -> tuple[pafs.FileSystem, str, Callable[[str], str]]:
    """File system of a path, its path there, and how paths there are written in full."""
    scheme, rest = path.split(":", 1) if ":" in path.split("/", 1)[0] else ("file", path)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/"), lambda inner: "file:" + inner
    system, inner = pafs.FileSystem.from_uri(path)
    host = urllib.parse.urlsplit(path).netloc
    # Object stores have the bucket as the first part of the inner path, others in the address.
    front = f"{scheme}://" if inner.split("/", 1)[0] == host else f"{scheme}://{host}"
    return system, inner, lambda inside: front + inside


def _reason(error: Exception) -> str:
    return f"ERR:{type(error).__name__}: {error}"[:ERROR_TEXT]


def _entries(path: str, glob: str | None) -> Iterator[tuple]:
    """Rows of ``_ENTRY`` for what lies directly in a folder, or for the one file that ``path`` is.

    Names that begin with a dot or underscore are skipped, as Spark's file sources do.
    """
    try:
        system, inner, full = opened(path)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner))
    except Exception as error:  # whatever a store answers, the outcome is a row
        yield path, None, None, _reason(error), FAILED
        return
    for entry in found:
        name = posixpath.basename(entry.path)
        if name.startswith((".", "_")):
            continue
        where = full(entry.path)
        if entry.type == pafs.FileType.Directory:
            yield where, None, None, None, FOLDER
        elif glob is None or fnmatchcase(name, glob):
            when = datetime.fromtimestamp(entry.mtime_ns // 1_000_000 / 1e3, timezone.utc) if entry.mtime_ns else None
            yield where, entry.size, when, SUCCESS, FILE


def _list(glob: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in _entries(path, glob):
                    rows.append(row)
                    if len(rows) >= ENTRIES_PER_BATCH:
                        yield _batch(rows, _ENTRY_ARROW)
                        rows = []
        if rows:
            yield _batch(rows, _ENTRY_ARROW)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def list_files(spark: SparkSession, paths: str | Sequence[str] | DataFrame, glob: str | None = None,
               recursive: bool = True, tasks: int | None = None) -> DataFrame:
    """The manifest of all files below ``paths``, written.

    ``paths`` are folders or files, or a table with a column ``path`` of them. Every level of folders is
    one stage, in which each folder is listed by one task; a level's subfolders are dealt out evenly to the
    tasks of the next. A path that cannot be listed is a row with a status that says why, and a path given
    twice is listed once. A folder's own entries are held by its task while they are listed.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    if isinstance(paths, DataFrame):
        level = paths.select("path").distinct()
    else:
        level = spark.createDataFrame([(p,) for p in dict.fromkeys([paths] if isinstance(paths, str) else paths)], "path string")
    found = None
    while True:
        listed = materialize(level.repartition(tasks).mapInArrow(_list(glob), _ENTRY), "listing")
        files = listed.filter(F.col("kind") != FOLDER).drop("kind")
        found = files if found is None else found.unionByName(files)
        level = listed.filter(F.col("kind") == FOLDER).select("path")
        if not recursive or level.isEmpty():
            return found


def packed(manifest: DataFrame, bytes_per_task: int = BYTES_PER_TASK, open_cost: int = OPEN_COST) -> tuple[DataFrame, int]:
    """(manifest with a ``pack`` number from 0, number of packs).

    Files are laid end to end, ``open_cost`` bytes between them, and cut every ``bytes_per_task``: a pack
    exceeds that by its last file at most. Each task of the manifest adds its own files up; sums of tasks
    are added up over tasks.
    """
    names = manifest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts = []
            for length in batch.column(names.index("length")).to_pylist():
                starts.append(offset)
                offset += (length or 0) + open_cost
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64())], names=[*names, "_part", "_start"])

    started = materialize(manifest.mapInArrow(run, schemas.with_fields(manifest.schema, _part=schemas.INT, _start=BIGINT)), "packs")
    cost = F.coalesce("length", F.lit(0)) + open_cost
    parts = started.groupBy("_part").agg(F.max(F.col("_start") + cost).alias("_size"))
    # One row per task of the manifest.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))), "pack-offsets")
    total = parts.agg(F.max(F.col("_before") + F.col("_size"))).first()[0] or 0
    pack = F.floor((F.col("_before") + F.col("_start")) / F.lit(bytes_per_task)).cast("int")
    return started.join(parts, "_part").select(*names, pack.alias("pack")), max(1, -(-total // bytes_per_task))


def _content(path: str | None, length: int | None, status: str | None) -> tuple[bytes | None, str | None]:
    if status is not None and status != SUCCESS:
        return None, status
    if length is not None and length > LARGEST_ROW:
        return None, f"ERR:{length} bytes are more than a row holds"
    try:
        system, inner, _ = opened(path)
        with system.open_input_stream(inner) as stream:
            return stream.read(), SUCCESS
    except Exception as error:  # gone, forbidden, out of reach: a row either way
        return None, _reason(error)


def read_files(manifest: DataFrame, bytes_per_task: int = BYTES_PER_TASK, open_cost: int = OPEN_COST) -> DataFrame:
    """The files of a manifest with their bytes, one row each: the columns of ``scan_binary`` and ``status``.

    Manifest rows are dealt to tasks in packs of equal bytes, and files are opened in the task; a file that
    cannot be read is a row without content. Rows leave a task in batches of bounded size.
    """
    rows = manifest.select("path", "modificationTime", "length", "status")
    dealt, packs = packed(rows, bytes_per_task, open_cost)
    return content_of(dealt.repartitionById(packs, F.col("pack")).drop("pack"))


def content_of(rows: DataFrame) -> DataFrame:
    """Manifest rows with their bytes, read where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for path, when, length, status in zip(*(batch.column(i).to_pylist() for i in range(4))):
                content, status = _content(path, length, status)
                out.append((path, when, length, content, status))
                size += len(content or b"")
                if size >= BYTES_PER_BATCH:
                    yield _batch(out, _READ_ARROW)
                    out, size = [], 0
            if out:
                yield _batch(out, _READ_ARROW)

    return rows.select("path", "modificationTime", "length", "status").mapInArrow(run, READ_FILES)
