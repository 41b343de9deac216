"""Column functions. Everything is built from Spark SQL expressions unless the module says why not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` over a value that is computed once, however often ``build`` uses it."""
    return F.get(F.transform(F.array(value), build), 0)
