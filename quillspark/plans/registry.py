"""Every query of the engine by name, and the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def load() -> None:
    """Imports the modules that register queries."""
    from quillspark.plans import cleaning, documents, indexing, parsing, retrieval  # noqa: F401
