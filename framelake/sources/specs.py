"""Declarative description of a file source: how to classify and what to extract.

Add a survey by building a ``SourceSpec``; nothing needs to be subclassed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from framelake import schemas
from framelake.functions import naming
from framelake.functions.measures import size_mb
from framelake.operators.relational import conform_to_schema

Extractor = Callable[[Column], Column]


@dataclass(frozen=True)
class SourceSpec:
    name: str
    patterns: Sequence[tuple[str, str]] = ()
    extractors: dict[str, Extractor] = field(default_factory=dict)

    def with_pattern(self, data_type: str, pattern: str) -> SourceSpec:
        return replace(self, patterns=[*self.patterns, (data_type, pattern)])

    def with_extractor(self, name: str, extractor: Extractor) -> SourceSpec:
        return replace(self, extractors={**self.extractors, name: extractor})


# File name patterns of the two known surveys, first match wins.
ZTF_PATTERNS = [
    ("SCIENCE", r"_science\.fits$"),
    ("DIFFERENCE", r"_difference\.fits$"),
    ("TEMPLATE", r"_template\.fits$"),
]
HSC_PATTERNS = [("CALIBRATED", r"HSCA.*\.fits$"), ("RAW", r"HSCR.*\.fits$")]
HSC_VISITS = 100_000
HSC_DETECTORS = 104

ZTF = SourceSpec(
    "ZTF",
    ZTF_PATTERNS,
    {
        "field_id": naming.field_id,
        "ccd_id": naming.ccd_id,
        "filter_band": lambda path: naming.filter_band(naming.ccd_id(path)),
        "observation_date": naming.observation_date,
        "exposure_id": naming.exposure_id,
    },
)
HSC = SourceSpec(
    "HSC",
    HSC_PATTERNS,
    {
        "visit_id": lambda path: naming.stable_bucket(path, HSC_VISITS),
        "detector_id": lambda path: naming.stable_bucket(path, HSC_DETECTORS),
    },
)


def extract_metadata(df: DataFrame, path: str, spec: SourceSpec) -> DataFrame:
    """Add telescope, data_type and one column per extractor; no match gives null."""
    column = F.col(path)
    return df.withColumns(
        {
            "telescope": F.lit(spec.name),
            "data_type": naming.classify_by_patterns(column, spec.patterns),
            **{name: extract(column) for name, extract in spec.extractors.items()},
        }
    )


def source_catalog_rows(
    files: DataFrame, spec: SourceSpec, run_timestamp: str, path: str = "path",
    length: str = "length",
) -> DataFrame:
    """Catalogue rows of one source from a file listing, with the true file size."""
    described = extract_metadata(files, path, spec).withColumns(
        {
            "file_path": F.col(path),
            "file_size_mb": size_mb(length),
            "processing_timestamp": F.lit(run_timestamp),
        }
    )
    return conform_to_schema(described, schemas.CATALOG)
