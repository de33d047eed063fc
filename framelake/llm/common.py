"""What the text operators share: table access, words of a text, Arrow schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of characters outside this set; the set is that of ``bytes.split``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; other letters keep their case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_count(text: Column | str) -> Column:
    """Number of words of a text column as long; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Arrow types of the DDL names used here.
ARROW = {
    "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
    "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def schema_of(ddl: str) -> pa.Schema:
    """Arrow schema of ``name type, name type``."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in ddl.split(","))])
