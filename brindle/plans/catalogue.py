"""The queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import checks, designs, graphs, lookups, metrics, signals, texts
from brindle.plans.metrics import flagship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = metrics.QUERIES | texts.QUERIES | graphs.QUERIES | signals.QUERIES | lookups.QUERIES | designs.QUERIES | checks.QUERIES
ORACLES: dict[str, str] = metrics.ORACLES | texts.ORACLES | graphs.ORACLES | signals.ORACLES | lookups.ORACLES | designs.ORACLES | checks.ORACLES

__all__ = ["ORACLES", "QUERIES", "flagship"]
