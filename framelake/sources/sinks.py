"""Writers. Each returns the path it wrote."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from framelake.schemas import BIGINT, STRING, struct
from framelake.sources.manifest import opened
from framelake.workspace import materialize


def _with_files(df: DataFrame, files: int | None) -> DataFrame:
    # A shuffle in front of the sink keeps the stage that computes the rows at full parallelism,
    # where coalesce would shrink it to `files` tasks.
    return df if files is None else df.repartition(files)


def sink_parquet(df: DataFrame, path: str, files: int | None = None,
                 partition_by: Sequence[str] = ()) -> str:
    writer = _with_files(df, files).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def sink_csv(df: DataFrame, path: str, files: int | None = None) -> str:
    _with_files(df, files).write.mode("overwrite").option("header", "true").csv(path)
    return path


def line_of(columns: Sequence[str], formats: dict[str, str] | None = None) -> Column:
    """The columns as one comma-joined text; nulls print as ``None``."""
    formats = formats or {}
    texts = [
        F.format_string(formats[c], F.col(c)) if c in formats else F.col(c).cast("string")
        for c in columns
    ]
    none = F.lit("None")
    return F.concat_ws(
        ",", *[F.when(F.col(c).isNull(), none).otherwise(t) for c, t in zip(columns, texts)]
    )


def sink_text_rows(df: DataFrame, path: str, columns: Sequence[str] | None = None,
                   formats: dict[str, str] | None = None, files: int | None = None) -> str:
    lines = df.select(line_of(columns or df.columns, formats).alias("value"))
    _with_files(lines, files).write.mode("overwrite").text(path)
    return path


def sink_json_report(report: DataFrame, path: str) -> str:
    """A report is one row of structs, arrays and maps; it becomes one JSON document."""
    written = materialize(report, "report")  # the plan behind a report runs once
    if len(written.take(2)) > 1:
        raise ValueError("a report has one row")
    written.coalesce(1).write.mode("overwrite").json(path)
    return path


def sink_publish_run(df: DataFrame, target: str, write=sink_parquet) -> str:
    """Write beside the target, then put it in place.

    The old run steps aside only when the new one is complete, comes back if the new one cannot
    take its place, and is deleted last. A crash between the two renames leaves it as
    ``<target>.__old__``, from where the next call restores it before it starts.
    """
    spark = df.sparkSession
    staging = target.rstrip("/") + ".__tmp__"
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, final, aside = (hadoop.Path(p) for p in (staging, target, target.rstrip("/") + ".__old__"))
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(final):
            fs.delete(aside, True)
        else:
            fs.rename(aside, final)
    write(df, staging)
    if fs.exists(final) and not fs.rename(final, aside):
        raise RuntimeError(f"could not move {target} aside")
    if not fs.rename(source, final):
        if fs.exists(aside):
            fs.rename(aside, final)
        raise RuntimeError(f"could not move {staging} to {target}")
    fs.delete(aside, True)
    return target


#: One row per published run; the highest sequence is the current one.
POINTER = struct(sequence=BIGINT, run_id=STRING, folder=STRING)


def publish_run(df: DataFrame, base: str, run_id: str, write=sink_parquet) -> str:
    """Write a run into a folder of its own and then name it in the pointer table, in one small file.

    Folders of runs are never written twice, moved or deleted here, and readers resolve the pointer. Until
    the pointer's file is there they get the run before, whatever step fails; a run that is not named is not
    seen. That needs no rename of folders, which object stores do not have. Of two publishers at once the run
    whose folder's name is higher becomes the current one.
    """
    base, spark = base.rstrip("/"), df.sparkSession
    folder = f"{base}/runs/{run_id}-{uuid.uuid4().hex}"
    write(df, folder)
    before = published_runs(spark, base).agg(F.max("sequence")).first()[0]
    row = spark.createDataFrame([((before or 0) + 1, run_id, folder.removeprefix(f"{base}/"))], POINTER)
    row.coalesce(1).write.mode("append").parquet(f"{base}/pointers")
    return folder


def published_runs(spark: SparkSession, base: str) -> DataFrame:
    """sequence, run_id and folder of all published runs; empty before the first."""
    try:
        return spark.read.schema(POINTER).parquet(f"{base.rstrip('/')}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def current_run(spark: SparkSession, base: str) -> str | None:
    """Folder of the current run; None before the first is published."""
    newest = published_runs(spark, base).agg(F.max(F.struct("sequence", "folder")).alias("newest")).first()[0]
    return newest and f"{base.rstrip('/')}/{newest['folder']}"


def sink_buckets(df: DataFrame, table: str, path: str, by: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table in ``buckets`` by the hash of a column, one file each, and read it as such.

    Aggregates and joins by that column then find their rows together and need no exchange.
    """
    rows = df.repartition(buckets, by).sortWithinPartitions(by)
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(table)
    return df.sparkSession.table(table)


def run_tag(df: DataFrame, run_id: str, out: str = "run_id") -> DataFrame:
    """The caller names the run; nothing here reads the clock."""
    return df.withColumn(out, F.lit(run_id))


def tagged_path(base: str, run_id: str) -> str:
    return f"{base}_{run_id}"


def sink_cutouts(cutouts: DataFrame, path: str) -> str:
    """Cutouts as one table with a file name per row: no file per image to open later."""
    cutouts.select("candid", "kind", "file_name", "content").write.mode("overwrite").parquet(path)
    return path


#: Files in a folder of ``sink_image_files``, about, and what a missing name is written as.
FILES_PER_FOLDER, NO_NAME = 1_000, "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def _write_files(base: str, folders: int):
    """A function over rows of names and bytes that writes a file of each."""

    def run(rows: Iterator[Row]) -> None:
        system, inner, _ = opened(base)
        made, attempt = set(), TaskContext.get().taskAttemptId()
        for name, data in rows:
            file = _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", name)
            folder = f"{inner}/{zlib.crc32(file.encode()) % folders:06d}"
            if folder not in made:
                system.create_dir(folder)
                made.add(folder)
            _write_file(system, f"{folder}/name={file}", f"{folder}/_{attempt}", data or b"")

    return run


def _write_file(system: pafs.FileSystem, final: str, hidden: str, data: bytes) -> None:
    """A file that is whole when it has its name."""
    with system.open_output_stream(hidden) as stream:
        stream.write(data)
        stream.write(b"\n")
    try:
        system.move(hidden, final)
    except OSError:  # a store that moves onto no file: another attempt of the task has written it
        if system.get_file_info(final).type != pafs.FileType.File:
            raise
        system.delete_file(hidden)


def sink_image_files(df: DataFrame, path: str, name: str = "file_name", content: str = "content") -> str:
    """One file per row, named ``path/<folder>/name=<file name>``, for tools that need files.

    Tasks write the files, in folders of about ``FILES_PER_FOLDER`` by a hash of the name: neither folders
    nor work of the driver come with each file. A line end lies behind the padded image and is not read.
    Rows of equal names would share a file, so they are refused. Where only Spark can open ``path``, its
    text writer writes ``path/name=<file name>/``, a folder per file.
    """
    spark = df.sparkSession
    rows = df.select(
        F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(NO_NAME)).alias("name"),
        F.col(content).cast("binary").alias("content"))
    named = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total, most = named.agg(F.sum("n"), F.max(F.struct("n", "name"))).first()
    if most and most["n"] > 1:
        raise ValueError(f"{most['n']} rows are named {most['name']}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(target).toString()
    try:
        opened(full)
    except (OSError, ValueError):  # pyarrow knows no such store
        lines = rows.select("name", F.col("content").cast("string").alias("value"))
        lines.write.mode("overwrite").partitionBy("name").text(path)
        return path
    fs.delete(target, True)
    fs.mkdirs(target)
    folders = -(-(total or 0) // FILES_PER_FOLDER)
    try:
        # Row by row: Arrow batches count rows, however large the images are.
        rows.foreachPartition(_write_files(full, folders))
    except Exception:
        fs.delete(target, True)  # all files or none
        raise
    return path


def named_image_files(files: DataFrame) -> DataFrame:
    """Give files written by ``sink_image_files`` the path they stand for, escapes undone; other paths stay."""
    folder = F.regexp_extract("path", r"^(.*)/(?:[^/]*/name=[^/]*|name=[^/]*/[^/]*)$", 1)
    name = F.regexp_extract("path", r"/name=([^/]*)(?:/[^/]*)?$", 1)
    plain = lambda text: F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return files.withColumn(
        "path", F.when(F.col("path").rlike(r"/name=[^/]*(/[^/]*)?$"), F.concat(folder, F.lit("/"), plain(name))).otherwise(F.col("path")))
