"""Importing this package registers every query."""

from framelake.registry import (  # noqa: F401
    aggregates,
    compositions,
    files,
    images,
    live,
    machine_learning,
    names,
    rows,
    runs,
    sources_sinks,
)
from framelake.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
