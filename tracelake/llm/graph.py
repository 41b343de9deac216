"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import stage


def _least() -> Column:
    """For pairs (u, v): the least value that u meets, itself included."""
    return F.least("u", F.min("v").over(Window.partitionBy("u")))


def _rows(*pairs: tuple[str, str], names: tuple[str, str]) -> Column:
    return F.inline(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(pair, names, strict=True)]) for pair in pairs]))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the least node that it reaches.

    Each round points every node at the least neighbour known and keeps distinct pairs, so paths halve. A round is three
    shuffles in one line, none read twice. Rounds are stored; they end when none changes a pair.
    """
    now = stage(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct())
    mark = None
    while True:
        both = now.select(_rows(("x", "y"), ("y", "x"), names=("u", "v")))
        large = both.withColumn("m", _least()).where("v > u and v <> m")
        down = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = down.withColumn("m", _least())
        now = stage(small.select(_rows(("v", "m"), ("u", "m"), names=("x", "y"))).where("x <> y").distinct())
        row = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    least = now.groupBy("x").agg(F.min("y").alias("y"))
    return least.select(F.col("x").alias("node"), F.col("y").alias("component")).union(
        now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    )
