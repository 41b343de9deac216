"""Id and time predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Device names that cannot be folder names.
RESERVED_NAMES = ("con", "prn", "aux", "nul") + tuple(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10))


def is_run_id(c: Column) -> Column:
    return (
        c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z") & ~F.lower(c).isin(*RESERVED_NAMES) & ~F.endswith(c, F.lit("."))
    )


def is_event_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z")


def is_timestamp(c: Column) -> Column:
    """RFC 3339 with an offset, a real calendar date, and a year from 1970 on."""
    shape = c.rlike(
        r"^(19[7-9]\d|[2-9]\d{3})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
        r"(\.\d{1,9})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
    )
    # Some years between 1970 and 1999 and all from 2000 on pass; the date itself must exist.
    real = F.substring(c, 1, 10).try_cast("date").isNotNull()
    return shape & real
