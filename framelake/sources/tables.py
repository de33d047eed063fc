"""Tabular and file sources as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, types as T

from framelake import schemas


def scan_binary(spark: SparkSession, path: str | Sequence[str], glob: str | None = None,
                recursive: bool = False) -> DataFrame:
    """Files with their bytes: path, modificationTime, length, content.

    Spark packs files into tasks by ``spark.sql.files.maxPartitionBytes`` with
    ``spark.sql.files.openCostInBytes`` added per file. For many small images lower the open
    cost; the byte limit also bounds the batch of images a Python task holds.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path if isinstance(path, str) else list(path))


def scan_listing(spark: SparkSession, path: str | Sequence[str], glob: str | None = None,
                 recursive: bool = False) -> DataFrame:
    """Names, sizes and times only: file contents are pruned from the scan."""
    return scan_binary(spark, path, glob, recursive).select("path", "length", "modificationTime")


def scan_listings(spark: SparkSession, paths: Sequence[str], glob: str | None = None
                  ) -> tuple[DataFrame | None, list[str]]:
    """Listing of all readable paths together, and the paths that could not be read.

    Each path is listed once, by Spark; a missing one fails there and then.
    """
    listings, skipped = [], []
    for path in paths:
        try:
            listings.append(scan_listing(spark, path, glob))
        except (PySparkException, Py4JError):  # missing, unreachable, unknown file system
            skipped.append(path)
    return (reduce(DataFrame.union, listings) if listings else None), skipped


def scan_parquet(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None):
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header line. Without a schema the types cost one more pass over the files."""
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    return reader.csv(path)


def scan_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path if isinstance(path, str) else list(path))


def scan_alerts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Alert packets with up to three gzipped stamps. ``avro`` needs Spark's Avro module."""
    return spark.read.format(fmt).schema(schemas.ALERTS).load(path)


def rows_from_memory(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
