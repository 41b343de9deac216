"""Jaccard self-join on word n-grams: T-occurrence search with DivideSkip, sharded by rare shingles.

Sets of equal shingles are one class from the start. Shingles have one order for all sets, rare ones first, by counts in a table of fixed size.
Two sets that reach the threshold have ``SHARED`` of their first shingles in common, of so many as may be missing in a partner and ``SHARED``
more. Classes that share so many are one family (a passage that many documents hold comes last in their order, so it makes no
family), and only families are searched. A family is searched in
blocks of bounded weight: per block an inverted list for each shingle; per set, the short lists are merged by
a heap, sets seen often enough are probed in the long lists by binary search, and those that reach the required overlap are links.
A link joins two classes at once, so a block gives at most one edge per set; no pair list of a group exists anywhere.

Defined results: null or blank texts have no shingles and are linked with nothing; a text with fewer words than a
shingle is one shingle; rows with a null id are counted but link nothing; repeated rows are in one class; an empty table gives no rows. Only the
id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from .graph import components
from .mixing import CHUNK, _packed, _unpacked

#: Rows up to which the ids of documents in families are broadcast; above, they are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Shingles in one side of a block. A family that has more is searched in several blocks.
BLOCK_SHINGLES = 1_500_000
#: Signatures that two linked sets have in common at least, if they have so many shingles. Lists of up to ``SHORT_LIST`` sets with an equal
#: signature are counted pair by pair; a longer list counts as enough by itself, so that no long one is written out as pairs.
SHARED, SHORT_LIST = 3, 32
#: Slots of the table that counts shingles, by their upper bits.
SLOT_BITS = 22
#: Weight of the length of the longest list in the choice of how many lists are long.
MU = 0.01
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (blank and \\x09 to \\x0D), A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; a shorter text is one run."""
    words = words_of(text)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], dtype=np.uint64)
    each = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    run = np.zeros(len(each) - n + 1, dtype=np.uint64)
    for i in range(n):
        run = _mixed(run + each[i : len(each) - n + 1 + i] + np.uint64(i))
    return np.unique(run)


@dataclass(frozen=True)
class Measure:
    """Word runs of ``n``, and links at a Jaccard similarity of ``num / den`` or more."""

    n: int
    num: int
    den: int

    def reaches(self, overlap, a: int, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def least_overlap(self, a: int) -> int:
        """Shingles that a set of ``a`` shares with any partner that is no larger."""
        smaller = -(-self.num * a // self.den)
        return -(-self.num * (a + smaller) // (self.num + self.den))

    @property
    def least_shared(self) -> int:
        """Signatures that different linked sets share: ``SHARED``, or all shingles that the smallest of them have in common."""
        return min(SHARED, -(-self.num // max(self.den - self.num, 1)))


def _slots(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def signatures(sets: np.ndarray, measure: Measure, common: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set, rare ones first by ``common`` (a rank for each slot), then by hash.

    The set has a share of its size in common with any partner. As many shingles as may be missing in the partner, and ``SHARED``
    more, hold the ``SHARED`` first common ones of both sets, whatever the order is.
    """
    size = len(sets)
    if measure.den * size < measure.num * (size + 1):  # too small for any other set
        return np.zeros(0, dtype=np.int64)
    first = size + measure.num * size // -measure.den + SHARED
    if common is not None:
        sets = sets[np.argsort(common[_slots(sets)], kind="stable")]
    return sets[:first].view(np.int64)


def search(sets: list[np.ndarray], sides: list[int], measure: Measure) -> list[tuple[int, int]]:
    """Links among ``sets`` (of different sides, if there are two), enough of them to connect all that are linked.

    DivideSkip: a set of size ``a`` needs ``T`` common shingles with a partner. Of its inverted lists the
    ``L`` longest are set aside; a partner must be in ``T - L`` of the others, which a heap merges in order of
    set numbers; such sets are looked up in the ``L`` long lists by binary search.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    side = np.array([sides[i] for i in order])
    two = len(set(sides)) > 1
    flat = np.concatenate([sets[i] for i in order])
    by = np.argsort(flat, kind="stable").astype(np.int32)
    flat = flat[by]
    post = np.repeat(np.arange(len(order), dtype=np.int32), sizes)[by]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = flat[1:] != flat[:-1]
    del flat
    number = np.cumsum(first, dtype=np.int32) - 1
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(first)))
    codes = number.astype(np.int64) * len(order) + post  # ascending: lists in order, and set numbers within a list
    lists = np.empty(len(first), dtype=np.int32)
    lists[by] = number
    del by, number, first
    ends = np.cumsum(sizes)
    parent = list(range(len(order)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for x in range(1, len(order)):
        size = int(sizes[x])
        need = measure.least_overlap(size)
        own = lists[ends[x] - size : ends[x]]
        own = own[lengths[own] > 1]
        if len(own) < need:
            continue
        own = own[np.argsort(lengths[own], kind="stable")]
        n_long = min(int(need / (MU * log2(lengths[own[-1]]) + 1)), need - 1)
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        seen, common = [], []
        heap = heapq.merge(*(post[starts[q] : starts[q] + lengths[q]].tolist() for q in short))
        for y, group in groupby(heap):
            if y >= x:
                break
            count = sum(1 for _ in group)
            if count >= need - n_long and (not two or side[y] != side[x]) and root(y) != root(x):
                seen.append(y)
                common.append(count)
        if not seen:
            continue
        found, overlap = np.array(seen), np.array(common)
        if n_long:
            probe = (long[:, None].astype(np.int64) * len(order) + found[None, :]).ravel()
            at = np.minimum(np.searchsorted(codes, probe), len(codes) - 1)
            overlap = overlap + (codes[at] == probe).reshape(len(long), -1).sum(axis=0)
        for y in found[measure.reaches(overlap, size, sizes[found])].tolist():
            if root(y) != root(x):
                parent[root(y)] = root(x)
                links.append((order[y], order[x]))
    return links


def _commonness(docs: DataFrame, measure: Measure, text: str) -> np.ndarray:
    """A rank for each slot of shingles, by how many sets have a shingle there: counted over all texts, of fixed size whatever the input."""
    fields, slots = "chunk int, data binary", 1 << SLOT_BITS

    def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["chunk", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_row = np.zeros(slots, dtype=np.uint32), False
        for batch in batches:
            for t in batch.column(0):
                np.add.at(counts, _slots(shingles(t.as_py(), measure.n)), 1)
                any_row = True
        if any_row:
            yield batch_of([(i, _packed(counts[i * CHUNK : (i + 1) * CHUNK])) for i in range(-(-slots // CHUNK))])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for chunk, group in groupby(rows, key=lambda r: r[0]):
            total = sum(_unpacked(data, "<u4").astype(np.uint64) for _, data in group)
            yield batch_of([(chunk, _packed(np.log2(total + 1.0).astype(np.float32)))])

    parts = docs.select(F.col(text).cast("string")).mapInArrow(count, fields)
    out = np.zeros(slots, dtype=np.float32)
    for row in parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(united, fields).collect():
        own = _unpacked(row["data"], "<f4")
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(own)] = own
    return (out * 2047).astype(np.uint16)


def _shingled(docs: DataFrame, measure: Measure, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null if empty) and signatures."""
    common = docs.sparkSession.sparkContext.broadcast(_commonness(docs, measure, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 1_000):
                sets = [shingles(t, measure.n) for t in batch.column(1).slice(at, 1_000).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 1_000),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([signatures(s, measure, common.value) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "node", "parts"],
                )

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, node binary, parts array<bigint>"
    )


def _classes(sets: DataFrame) -> DataFrame:
    """One stored row, of those with an id, for each distinct set. Equal sets are found by an aggregate of narrow rows."""
    named = sets.where("node IS NOT NULL AND doc_id IS NOT NULL AND row IS NOT NULL")
    first = named.groupBy("node").agg(F.min("row").alias("first"))
    copies = stage(named.select("node", "row").join(first, "node").where("row <> first").select("row"))
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    return named.join(copies, "row", "left_anti")


def _families(classes: DataFrame, measure: Measure) -> DataFrame:
    """(row, family): classes that have enough signatures in common with another class, directly or through others.

    The signatures are dealt out once, for the aggregate that finds the shared ones and for the join that names who shares
    them. A group of near copies has many of them, so it spreads over as many tasks, and each is passed through as it comes.
    """
    parts = classes.select("row", F.explode("parts").alias("part")).repartition("part")
    shared = parts.groupBy("part").agg(F.min("row").alias("least"), F.count("*").alias("n")).where("n > 1")
    lists = stage(parts.join(shared.hint("merge"), "part"))
    long = lists.where(F.col("n") > SHORT_LIST).where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    held = lists.where(F.col("n") <= SHORT_LIST).groupBy("part").agg(F.array_sort(F.collect_set("row")).alias("held"))
    pairs = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, SHORT_LIST), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    short = held.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= measure.least_shared).select("a", "b")
    return components(long.union(short)).withColumnsRenamed({"node": "row", "component": "family"})


def _links(docs: DataFrame, sets: DataFrame, measure: Measure, doc_id: str, text: str) -> DataFrame:
    """(a, b): digests of linked classes, at most one row for each class of a block."""
    rows = _classes(sets)
    classes = stage(rows.select("row", "node", "doc_id", F.col("n_shingles").alias("n")).join(_families(rows, measure), "row").drop("row"))
    weight = classes.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    members = classes.drop("n").join(weight.drop("n"), "family").select("doc_id", "node", "family", "blocks")
    if classes.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).join(members, "doc_id")
    own, pair = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("family", own.alias("own"), pair.alias("other"), "node", "text")
    rows = rows.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, block in groupby(each(), key=lambda r: r[:3]):
            held = {}
            for _, _, _, own, node, words in block:
                sets = shingles(words, measure.n)
                if xxhash.xxh3_128_digest(sets.tobytes()) == node:  # else another row with the same id
                    held[node] = (sets, own)
            if len(held) > 1:
                names = list(held)
                got = search([held[n][0] for n in names], [held[n][1] for n in names], measure)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([names[p] for p, _ in got]), pa.array([names[q] for _, q in got])], names=["a", "b"])

    rows = rows.repartition("family", "i", "j")
    return rows.sortWithinPartitions("family", "i", "j").mapInArrow(run, "a binary, b binary")


def join_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its number of shingles and ``component_id``, the least id that links reach from it."""
    measure = Measure(n, num, den)
    sets = stage(_shingled(docs, measure, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    named = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = components(_links(docs, sets, measure, doc_id, text))
    groups = linked.join(named, "node").groupBy("component").agg(F.min("least").alias("group_id"))
    linked = linked.join(groups, "component").select("node", "group_id")
    # stored, so that the join below has plain rows on both sides and a class with many copies can be split
    names = stage(named.join(linked, "node", "left").select("node", F.coalesce("group_id", "least").alias("group_id")))
    found = sets.select("doc_id", "n_shingles", "node").join(names, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id")).alias("component_id")
    return found.select("doc_id", "n_shingles", component)
