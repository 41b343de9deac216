"""Sinks: corpus artifacts, canonical trace export, flat summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import canonical_json


def write_corpus(frame: DataFrame, path: str, by: str = "source", fmt: str = "json") -> None:
    """Sanitized rows, one folder per source."""
    frame.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def export_trace(accepted: DataFrame, path: str, body: str = "body") -> None:
    """One canonical line per accepted record, ordered by run and sequence over range partitions."""
    lines = accepted.repartitionByRange("run_id", "sequence").sortWithinPartitions("run_id", "sequence")
    lines.select(canonical_json(F.col(body)).alias("value")).write.mode("overwrite").text(path)


def write_summary(totals: DataFrame, path: str) -> None:
    """The single row of corpus totals as JSON."""
    totals.coalesce(1).write.mode("overwrite").json(path)
