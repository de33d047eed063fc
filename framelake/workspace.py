"""Shared folder for intermediate tables, run outputs and stream checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session within one process, ``local`` or ``local[...]``, may fall back to a folder of its
    own: elsewhere a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="framelake-")
    return _LOCAL_ROOTS[app]


def run_folder(spark: SparkSession) -> str:
    """Where all intermediate tables of this application lie."""
    return f"{shared_root(spark)}/framelake/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_run(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. DataFrames that read them are void then,
    so call it when the results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark deletes a query's shuffle files once it has run.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings of the session meanwhile, and what it had before afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def materialize(df: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    The lineage is cut at data that outlives any executor, and values that depend on how rows
    were partitioned are fixed from here on. ``tidy`` deletes the shuffle files of this write when it is done;
    else they lie on the executors' disks until the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with setting(spark, {_TIDY: "true"} if tidy else {}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
