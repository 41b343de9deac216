"""Ordered per-key scans that never put a whole key into one task.

A plain ``Window.partitionBy(session)`` sends all rows of a session to one task, so one hot session
stalls the job. Every scan here is associative, so it splits: rows are grouped by (key, chunk), with
a chunk being a slice of the order (an hour of a session, 65,536 sequence numbers of a run). Each
chunk is scanned locally; one summary row per chunk carries the state over the chunk borders; the
summaries, far fewer than the rows, are scanned per key and joined back on (key, chunk), which is
the partitioning the local scan already has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

HOUR_MS = 3_600_000
SEQUENCE_CHUNK = 65_536


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column
    where: Column | None = None
    inclusive: bool = False


def running_sum(value: Column, inclusive: bool = True) -> Scan:
    """Sum over the rows up to this one (or strictly before it)."""
    return Scan("sum", value, None, inclusive)


def running_min(value: Column) -> Scan:
    """Least value over the rows up to this one."""
    return Scan("min", value, None, True)


def last_seen(value: Column, where: Column | None = None, inclusive: bool = False) -> Scan:
    """Value of the nearest earlier row that meets ``where``; the value itself may be null."""
    return Scan("last", value, where, inclusive)


def next_seen(value: Column, where: Column | None = None) -> Scan:
    """Value of the nearest later row that meets ``where``."""
    return Scan("next", value, where)


def time_chunk(ts_ms: str = "ts_ms", index: str = "input_index", width_ms: int = HOUR_MS) -> Column:
    """Chunk of a (time, input index) order. Rows without a readable time (0) are cut by index."""
    ms, idx = F.col(ts_ms), F.col(index)
    undated = F.floor(idx / SEQUENCE_CHUNK) - F.lit(1 << 40)
    return F.when(ms == 0, undated).otherwise(
        F.floor(ms / width_ms) - F.when(ms < 0, F.lit(1 << 42)).otherwise(F.lit(0))
    )


def sequence_chunk(sequence: str = "sequence", rows: int = SEQUENCE_CHUNK) -> Column:
    return F.floor(F.col(sequence) / rows)


def one_chunk(df: DataFrame, sequence: str = "sequence") -> bool:
    """Whether all rows lie in one chunk of ``sequence``. Reads one column, so only for frames that are stored."""
    at = sequence_chunk(sequence)
    low, high = df.agg(F.min(at), F.max(at)).first()
    return low == high


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column | str, whole: bool = False, **scans: Scan) -> DataFrame:
    """Add one column per named scan. Keys must be non-null and ``order`` must be total per key.

    ``whole`` says that no key has rows in two chunks (``one_chunk``): then there are no borders to carry anything over.
    A chunk that is named, as a column of ``df``, stays there: scans in a row over it move the rows once.
    """
    named = chunk if isinstance(chunk, str) else "_chunk"
    parts = [*keys, named]
    cols = df.columns
    fwd = Window.partitionBy(*parts).orderBy(*order)
    bwd = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    before = (Window.unboundedPreceding, -1)
    upto = (Window.unboundedPreceding, 0)

    if not isinstance(chunk, str):
        df = df.withColumn(named, chunk)
    boxed = {}
    for name, s in scans.items():
        if s.kind == "sum":
            boxed[f"_v_{name}"] = F.coalesce(s.value, F.lit(0)).cast("bigint")
        elif s.kind == "min":
            boxed[f"_v_{name}"] = s.value
        else:
            box = F.struct(s.value.alias("v"))
            boxed[f"_v_{name}"] = F.when(s.where, box) if s.where is not None else box
    df = df.withColumns(boxed)

    position = F.struct(*order)
    local, summary = {}, []
    for name, s in scans.items():
        v = F.col(f"_v_{name}")
        seen = F.when(v.isNotNull(), position)
        if s.kind == "sum":
            local[f"_l_{name}"] = F.sum(v).over(fwd.rowsBetween(*(upto if s.inclusive else before)))
            summary.append(F.sum(v).alias(f"_s_{name}"))
        elif s.kind == "min":
            local[f"_l_{name}"] = F.min(v).over(fwd.rowsBetween(*upto))
            summary.append(F.min(v).alias(f"_s_{name}"))
        elif s.kind == "last":
            frame = fwd.rowsBetween(*(upto if s.inclusive else before))
            local[f"_l_{name}"] = F.last(v, ignorenulls=True).over(frame)
            summary.append(F.max_by(v, seen).alias(f"_s_{name}"))
        else:
            local[f"_l_{name}"] = F.last(v, ignorenulls=True).over(bwd.rowsBetween(*before))
            summary.append(F.min_by(v, seen).alias(f"_s_{name}"))

    if whole:
        near = {name: F.col(f"_l_{name}") for name in scans}
        out = [(F.coalesce(near[n], F.lit(0)) if s.kind == "sum" else near[n] if s.kind == "min" else near[n]["v"]).alias(n) for n, s in scans.items()]
        return df.withColumns(local).select(*cols, *out)

    borders = df.groupBy(*parts).agg(*summary)
    over_key = Window.partitionBy(*keys)
    earlier = over_key.orderBy(named).rowsBetween(*before)
    later = over_key.orderBy(F.col(named).desc()).rowsBetween(*before)
    carry = []
    for name, s in scans.items():
        v = F.col(f"_s_{name}")
        if s.kind == "sum":
            carry.append(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_c_{name}"))
        elif s.kind == "min":
            carry.append(F.min(v).over(earlier).alias(f"_c_{name}"))
        else:
            carry.append(F.last(v, ignorenulls=True).over(earlier if s.kind == "last" else later).alias(f"_c_{name}"))
    borders = borders.select(*parts, *carry)

    joined = df.withColumns(local).join(borders, parts)
    out = []
    for name, s in scans.items():
        near, far = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if s.kind == "sum":
            out.append((F.coalesce(near, F.lit(0)) + far).alias(name))
        elif s.kind == "min":
            out.append(F.least(near, far).alias(name))
        else:
            out.append(F.coalesce(near, far)["v"].alias(name))
    return joined.select(*cols, *out)


def trailing(df: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Rows after the last row of each key for which ``breaks`` holds (all rows when none does).

    One partial aggregate finds the last break, so no window over the key is needed.
    """
    last = df.groupBy(*keys).agg(F.max(F.when(breaks, F.struct(*order))).alias("_last_break"))
    return (
        df.join(last, keys)
        .where(F.col("_last_break").isNull() | (F.struct(*order) > F.col("_last_break")))
        .drop("_last_break")
    )


def top_rows(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of the whole frame; Spark keeps k rows per task and merges."""
    return df.orderBy(*order).limit(k)


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows of each group, in order, through ``fold``. Only for groups whose size is bounded by their rule.

    Groups are walked in batches of sorted rows, which costs far less than one call per group.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    ints = {c.strip().split(" ")[0] for c in schema.split(",") if c.strip().endswith("bigint")}

    def frame(rows: list[tuple]) -> pd.DataFrame:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pd.DataFrame({n: pd.Series(list(c), dtype="int64" if n in ints else object) for n, c in zip(names, cols, strict=True)})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for pdf in batches:
            for row in pdf.to_dict("records"):
                now = tuple(row[k] for k in keys)
                if now != key:
                    if held:
                        out += fold(key, held)
                    key, held = now, []
                held.append(row)
            if len(out) > 10_000:
                yield frame(out)
                out = []
        if held:
            out += fold(key, held)
        yield frame(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)
