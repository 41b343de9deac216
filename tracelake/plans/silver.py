"""Shared silver tables of a job: built once per session and data folder, read by many queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import stage

_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def silver(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = stage(build())
    return _BUILT[key]
