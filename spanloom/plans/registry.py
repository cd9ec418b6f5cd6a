"""Named queries over the driver's tables and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query function, with its oracle where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    load()
    return QUERIES["doc_green_text"](spark, sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    from spanloom.plans import analytics, calls, evaluation, recognition, released, replaced  # noqa: F401
