"""Packing of token pieces into sequences of one capacity.

Lengths are whole numbers from 1 to the capacity, so the corpus enters the packing decisions as a histogram: how many
pieces have each length. The decisions are made for whole classes of equal pieces and equal bins at once, in
time and memory that depend on the capacity alone, and come out as a plan of a few thousand rows. A piece finds its place from its
length and its number among the pieces of that length: (count in the blocks before) + (place in its block). No
piece passes through the driver and no length, however common, is gathered in one task.

Both methods make the same bins as their one-piece-at-a-time form would. A null or empty text is a piece of one id;
an empty table gives no rows; equal documents are packed separately.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import stage
from . import tokens

#: Rows of the small side up to which a join is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


class GapTree:
    """A segment tree over remaining capacities: which is the smallest one, at least ``need``, that some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, gap: int, bins: int) -> None:
        at = gap + self.leaves
        while at:
            self.tree[at] += bins
            at >>= 1

    def smallest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.tree[at]:
            return need
        while at > 1:  # climb until a right neighbour holds an open bin, then go down to its left-most one
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


class Bins:
    """Classes of equal bins. A class is a chain of (length, copies) and how many bins are so filled."""

    def __init__(self, capacity: int):
        self.capacity, self.tree = capacity, GapTree(capacity)
        self.open: dict[int, list[tuple[tuple, int]]] = {}

    def put(self, gap: int, chain: tuple, bins: int) -> None:
        if bins:
            self.open.setdefault(gap, []).append((chain, bins))
            self.tree.add(gap, bins)

    def fill(self, length: int, count: int) -> None:
        """Best fit for ``count`` pieces one after another: each goes to the fullest bin that can take it."""
        while count:
            gap = self.tree.smallest(length)
            if gap is None:
                gap, chain, bins = self.capacity, (), -(-count // (self.capacity // length))
            else:
                chain, bins = self.open[gap].pop()
                self.tree.add(gap, -bins)
            # the bin that takes a piece is then the fullest that can take the next one
            each = gap // length
            whole, rest = divmod(count, each)
            if whole >= bins:
                whole, rest = bins, 0
            self.put(gap - each * length, (chain, length, each), whole)
            if rest:
                self.put(gap - rest * length, (chain, length, rest), 1)
            if chain or gap < self.capacity:
                self.put(gap, chain, bins - whole - bool(rest))
            count -= whole * each + rest

    def plan(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first number, pieces, copies a bin, first sequence, first offset) for each class and length."""
        out, used, sequence = [], {}, 0
        for gap in sorted(self.open):
            for chain, bins in self.open[gap]:
                links = []
                while chain:
                    chain, length, copies = chain
                    links.append((length, copies))
                offset = 0
                for length, copies in reversed(links):
                    first = used.get(length, 0)
                    used[length] = first + bins * copies
                    out.append((length, first, bins * copies, copies, sequence, offset))
                    offset += length * copies
                sequence += bins
        return out


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Bins:
    """Longest pieces first, each into the fullest bin that can take it."""
    bins = Bins(capacity)
    for length in sorted(histogram, reverse=True):
        bins.fill(length, histogram[length])
    return bins


def large_item_matching(histogram: dict[int, int], capacity: int) -> Bins:
    """Pieces above a third of the capacity are matched greedily, at most two a bin; the others best-fit the gaps.

    The longest piece that is left is matched with the longest one that still fits beside it.
    """
    bins = Bins(capacity)
    left = dict(histogram)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, length in enumerate(large):
        for mate in large[i:]:
            if not left[length]:
                break
            if length + mate > capacity or not left[mate]:
                continue
            if mate == length:
                pairs = left[length] // 2
                bins.put(capacity - 2 * length, ((), length, 2), pairs)
                left[length] -= 2 * pairs
            else:
                pairs = min(left[length], left[mate])
                bins.put(capacity - length - mate, (((), length, 1), mate, 1), pairs)
                left[length] -= pairs
                left[mate] -= pairs
        bins.put(capacity - length, ((), length, 1), left[length])
        left[length] = 0
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        bins.fill(length, left[length])
    return bins


def assign(pieces: DataFrame, capacity: int, method) -> DataFrame:
    """Stored pieces with the sequence that takes them and the offset there. Two scans of narrow columns, no shuffle of pieces."""
    spark = pieces.sparkSession
    blocks = stage(pieces.groupBy("length", "block").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    shift = blocks.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    if blocks.count() <= BROADCAST_ROWS:
        shift = F.broadcast(shift)
    plan = spark.createDataFrame(
        method(histogram, capacity).plan(), "_length bigint, _first bigint, _n bigint, _copies bigint, _sequence bigint, _offset bigint"
    )
    numbered = pieces.join(shift, ["length", "block"]).withColumn("_number", F.col("_before") + F.col("place"))
    at = F.col("_number") - F.col("_first")
    placed = numbered.join(  # the plan's size depends on the capacity alone
        F.broadcast(plan), (F.col("length") == F.col("_length")) & (at >= 0) & (at < F.col("_n"))
    )
    return placed.select(
        *[c for c in pieces.columns if c not in ("block", "place")],
        (F.col("_sequence") + F.floor(at / F.col("_copies"))).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_copies") * F.col("length")).alias("offset"),
    )


def pack_pieces(docs: DataFrame, vocabulary: str, capacity: int = tokens.CAPACITY, method=large_item_matching) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(stage(tokens.pieces(docs, vocabulary, capacity)), capacity, method)


def pack_matrix(docs: DataFrame, vocabulary: str, capacity: int = tokens.CAPACITY, method=best_fit_decreasing, pad: int = 0) -> DataFrame:
    """One row per sequence, ready to be written: a row of the id matrix and what tells its segments apart.

    ``input_ids`` holds ``capacity`` ids, padded behind ``n_ids``; ``cu_seqlens`` the offsets at which segments begin, and
    the end of the last; ``position_ids`` counts from the piece's own start (0 for the first piece of a document, so positions reset at
    each segment) and is 0 in the padding; ``doc_ids``, ``pieces`` and ``starts`` name the segments in order. Pieces of
    one document hold its ids in turn, so the document can be put together again.
    """
    placed = assign(stage(tokens.pieces(docs, vocabulary, capacity, with_ids=True)), capacity, method)
    fields = (
        "sequence_id bigint, n_ids int, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, "
        "doc_ids array<bigint>, pieces array<int>, starts array<bigint>"
    )
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [f.split(" ")[0] for f in fields.split(", ")]
    count = np.arange(capacity, dtype=np.int32)

    def sequence(key: int, segments: list[tuple]) -> tuple:
        ids, positions = np.full(capacity, pad, dtype=np.int32), np.zeros(capacity, dtype=np.int32)
        bounds = [s[0] for s in segments]
        for offset, _, _, _, raw in segments:
            own = tokens.unpack(raw)
            ids[offset : offset + len(own)] = own
            positions[offset : offset + len(own)] = count[: len(own)]
            end = offset + len(own)
        return key, end, ids, [*bounds, end], positions, [s[1] for s in segments], [s[2] for s in segments], [s[3] for s in segments]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segments, out = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for part in batches:
            for now, *segment in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if now != key and segments:
                    out.append(sequence(key, segments))
                    segments = []
                    if len(out) >= 256:
                        yield batch()
                        out = []
                key = now
                segments.append(segment)
        if segments:
            out.append(sequence(key, segments))
        if out:
            yield batch()

    rows = placed.select("sequence_id", "offset", "doc_id", "piece", "start", "ids")
    return rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(run, fields)
