"""All queries of the market library, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketspark.plans import books, desk, extras, factors, files, market, records, regimes, studies

MODULES = (factors, market, records, desk, files, books, studies, regimes, extras)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for m in MODULES for n, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {n: q for m in MODULES for n, q in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars to alphas to gates: one record for each chosen alpha."""
    return factors.QUERIES["factor_gates"](spark, sf_dir)
