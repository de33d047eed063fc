"""Training corpus in five stages, each an operator of ``framelake.llm`` on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. Null texts count as empty; repeated rows stay rows of their own
until the near-duplicate stage; other columns are passed on; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelake.llm import decontamination, mixing, quality, secrets, simhash
from framelake.llm.common import table
from framelake.workspace import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Least probability of the highest grade that keeps a document.
LEAST_TAIL = 0.5
#: Near-duplicates: fingerprints of three-word shingles that differ by three bits or fewer, as the query has it.
SHINGLE, BITS = 3, 3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose probability of the highest grade is ``LEAST_TAIL`` or more."""
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")), levels=3)
    rated = quality.rate(docs, model, grade=2, least=LEAST_TAIL)
    return rated.filter("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the first by id, then by its row's hash."""
    return simhash.first_of_groups(docs, shingle=SHINGLE, threshold=BITS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    flagged = decontamination.is_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return flagged.filter("NOT contaminated").select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; the documents stay, with their new lengths."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often, and the words that this makes."""
    mixed = mixing.mix_documents(docs)
    return mixed.filter("copies > 0").select(*docs.columns, "copies", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
]

#: None: a trained classifier and compressed sizes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
