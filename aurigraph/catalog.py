"""Every registered query of the library with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import collection, files, generalization, kernels, passes, planning, registry, scoring, signals, verification

MODULES = (collection, files, generalization, kernels, passes, planning, scoring, signals, verification)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
