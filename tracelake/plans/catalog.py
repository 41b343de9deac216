"""All registered queries and oracles."""

from __future__ import annotations

from importlib import import_module

PARTS = ("sessions", "replay", "series", "scalars", "ingest", "answers", "evidence", "logs", "rollout", "intake", "native", "hooks", "streams")


def _parts():
    for name in PARTS:
        yield import_module(f"tracelake.plans.catalog_{name}")


def queries():
    return {k: q for part in _parts() for k, q in part.QUERIES.items()}


def oracles():
    return {k: q for part in _parts() for k, q in part.ORACLES.items()}
