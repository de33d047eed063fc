"""One catalogue over several file sources, and its quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from framelake import schemas
from framelake.functions.measures import percent_of
from framelake.functions.naming import UNKNOWN
from framelake.operators.relational import union_catalog
from framelake.sources.specs import SourceSpec, source_catalog_rows

NOT_PROFILED = ["quality_flags"]


def catalog(
    listings: Sequence[tuple[SourceSpec, DataFrame]],
    run_timestamp: str,
    path: str = "path",
    length: str = "length",
    spark=None,
) -> DataFrame:
    """All sources in the shared eleven columns. No Python worker, nothing gathered."""
    rows = [source_catalog_rows(df, spec, run_timestamp, path, length) for spec, df in listings]
    return union_catalog(rows, schemas.CATALOG, spark)


def quality_report(catalog_rows: DataFrame, timestamp: str) -> DataFrame:
    """Totals, files per source and missing values per column: one row from one scan.

    Counts are taken per source first, so the final row merges one row per source. Rows without a
    source count as ``UNKNOWN``.
    """
    names = [f.name for f in schemas.CATALOG.fields if f.name not in NOT_PROFILED]
    named = F.coalesce("telescope", F.lit(UNKNOWN)).alias("_source")
    per_source = catalog_rows.groupBy(named).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_m_{c}") for c in names],
    )
    total = per_source.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_files"),
        # One entry per registered source.
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_source", "_n"))))
        .alias("telescope_distribution"),
        *[F.coalesce(F.sum(f"_m_{c}"), F.lit(0)).alias(f"_m_{c}") for c in names],
    )
    metrics = [
        x
        for c in names
        for x in (
            F.lit(f"missing_{c}"),
            F.struct(
                F.col(f"_m_{c}").alias("missing_count"),
                percent_of(f"_m_{c}", "total_files").alias("missing_percentage"),
            ),
        )
    ]
    return total.select(
        F.lit(timestamp).alias("timestamp"),
        "total_files",
        "telescope_distribution",
        F.create_map(*metrics).alias("quality_metrics"),
    )
