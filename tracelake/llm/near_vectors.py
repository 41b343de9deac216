"""Near-duplicate vectors through a flat graph with robust pruning, built on overlapping shards.

Distinct vectors are assigned to their nearest centres, several each, so that the shards overlap. In each part of a shard the nearest
candidates of each vector, found by an exact comparison in blocks, are pruned robustly: a candidate goes if a kept one is nearer to it, by the factor
``ALPHA``, than the vector is. Edges go both ways, and the lists of a vector from all its shards are united. Then each vector is sought in
every part of its nearest shard: a greedy search from medoids follows the ``WIDTH`` best seen, and everything within ``RANGE`` below the threshold, until
nothing new is met. It starts at the medoid of each component of the graph there, and of each group of ``GROUP`` or more that edges within that range connect, for
dense groups have few edges to others. What it met is verified by the cosine in double precision. Recall is audited against brute force
for a sample of vectors; under ``LEAST_RECALL`` all is done again with three times as many shards a vector and three times the width,
until each vector is in every shard.

Centres are fitted on a bounded sample (``CENTRE_SAMPLE`` rows a centre, ``MAX_CENTRES`` centres at most); centres that lie
close together are thinned, so a dense group is not torn apart. Every vector is assigned and compared. A shard
beyond ``SHARD`` vectors is split by hash, and its queries visit every part, so no task holds more than a part.

Defined results: a vector that is null, zero or has a null or non-finite component links with nothing, and so do
vectors of different lengths with one another; equal vectors are one node and link with each other; a row
with a null id counts as a link of others and is reported with a null component; rows that repeat an id are rows of their own; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from .graph import components

SHARD = 2_000
#: Vectors for which one centre is made, and shards that each vector belongs to.
PER_CENTRE, OVERLAP = 500, 3
MAX_CENTRES, CENTRE_SAMPLE = 4_096, 16
MAX_LENGTHS = 64
#: Vectors that are compared with a part of a shard, or sought in it, at a time, and numbers that are gathered at a time.
BLOCK, GATHERED = 256, 1 << 22
#: Candidates before pruning, edges kept by it, and how much nearer a kept one must be to hide another.
CANDIDATES, DEGREE, ALPHA = 64, 32, 1.2
#: Best vectors that the search follows at least, and how far below the threshold it follows all.
WIDTH, RANGE = 16, 0.05
#: Least vectors of a dense group that has a medoid of its own.
GROUP = 8
#: Sampled vectors of the audit, and the recall below which shards and width are raised.
AUDITED, LEAST_RECALL = 256, 0.9


def _unit(rows) -> np.ndarray:
    """Rows, or an Arrow column of lists of one length, as unit vectors; the greatest number is divided out first, so no square overflows."""
    if isinstance(rows, pa.ListArray):
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    else:
        x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, wanted: int, rounds: int = 4) -> np.ndarray:
    """Centres of unit vectors by Lloyd's rounds; one of two centres with a cosine of 0.9 or more is left out."""
    centres = sample[:wanted]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    kept: list[np.ndarray] = []
    for c in centres:
        if not kept or (np.array(kept) @ c).max() < 0.9:
            kept.append(c)
    return np.array(kept)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    def each() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    return groupby(each(), key=lambda r: r[:keys])


def _centres(nodes: DataFrame, n: int) -> np.ndarray:
    wanted = min(MAX_CENTRES, -(-n // PER_CENTRE))
    sample = nodes.select("vector").orderBy(F.xxhash64("vector")).limit(wanted * CENTRE_SAMPLE).toArrow()
    return fit_centres(_unit(sample.column(0).combine_chunks()), wanted)


def _members(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """(shard, part, parts, home, node, copies, vector): each node in the shards of its nearest centres."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_unit(batch.column(2)) @ shared.value.T), axis=1, kind="stable")[:, :overlap]
            times = near.shape[1]
            picked = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel()), pa.array(np.tile(np.arange(times) == 0, batch.num_rows)), *picked.columns],
                names=["shard", "home", "node", "copies", "vector"],
            )

    members = stage(nodes.select("node", "copies", "vector").mapInArrow(assign, "shard bigint, home boolean, node bigint, copies bigint, vector array<double>"))
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).alias("parts"))  # one row per centre
    members = members.join(F.broadcast(sizes), "shard")
    return members.select("shard", F.pmod(F.xxhash64("node"), "parts").alias("part"), "parts", "home", "node", "copies", "vector")


def prune(sims: np.ndarray, between: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Which candidates of each vector stay: (rows, k) cosines, nearest first, and (rows, k, k) cosines between the candidates."""
    far, apart = 2 - 2 * sims, ALPHA**2 * (2 - 2 * between)  # squared distances
    open_, kept = np.ones(sims.shape, dtype=bool), np.zeros(sims.shape, dtype=bool)
    for k in range(sims.shape[1]):
        kept[:, k] = open_[:, k] & (kept.sum(axis=1) < degree)
        open_ &= ~(kept[:, k, None] & (apart[:, k, :] <= far))
    return kept


def pruned_edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (from, to) of the pruned graph of unit vectors, both ways, ordered."""
    n, found = len(x), []
    k, step = min(CANDIDATES, n - 1), max(1, min(BLOCK, GATHERED // (CANDIDATES * x.shape[1])))
    for at in range(0, n if k else 0, step):
        own = np.arange(at, min(n, at + step))
        sims = x[own] @ x.T
        sims[own - at, own] = -np.inf
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        those = x[near]
        row, place = np.nonzero(prune(np.take_along_axis(sims, near, 1), those @ those.transpose(0, 2, 1)))
        found.append(own[row] * n + near[row, place])
    flat = np.concatenate(found) if found else np.array([], dtype=np.int64)
    return np.divmod(np.unique(np.concatenate([flat, flat % n * n + flat // n])), n)


def _medoids(x: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = 1) -> np.ndarray:
    """The vector nearest to the mean of each component, of ``least`` or more, of the graph with the edges (a, b), given both ways."""
    label = np.arange(len(x))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    order = np.argsort(label, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    return np.array([g[np.argmax(x[g] @ x[g].mean(axis=0))] for g in groups if len(g) >= least], dtype=np.int64)


def medoids(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Where searches start: the medoids of the components, and those of the dense groups in them."""
    near = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + BLOCK * 64]], x[b[i : i + BLOCK * 64]]) for i in range(0, max(1, len(a)), BLOCK * 64)]) >= threshold - RANGE
    return np.union1d(_medoids(x, a, b), _medoids(x, a[near], b[near], GROUP))


def greedy_search(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, seeds: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """Cosines of queries with the vectors that their searches meet, minus infinity for the others."""
    n = len(x)
    start = np.searchsorted(a, np.arange(n + 1))
    score, expanded = np.full((len(q), n), -np.inf), np.zeros((len(q), n), dtype=bool)
    row, col = np.repeat(np.arange(len(q)), len(seeds)), np.tile(seeds, len(q))
    while len(row):
        for at in range(0, len(row), step := max(1, GATHERED // x.shape[1])):
            r, c = row[at : at + step], col[at : at + step]
            score[r, c] = np.einsum("ij,ij->i", q[r], x[c])
        best = np.partition(score, n - width, axis=1)[:, n - width] if n > width else np.full(len(q), -np.inf)
        ahead = (score >= np.minimum(best, threshold - RANGE)[:, None]) & (score > -np.inf) & ~expanded
        expanded |= ahead
        r, c = np.nonzero(ahead)
        size = start[c + 1] - start[c]
        edge = np.arange(size.sum()) + np.repeat(start[c] - np.cumsum(size) + size, size)
        met = np.unique(np.repeat(r * n, size) + b[edge])
        row, col = np.divmod(met[score.ravel()[met] == -np.inf], n)
    return score


def _graph(members: DataFrame) -> DataFrame:
    """(node, near): the neighbours of each node in the pruned graphs of all its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 2):
            ids, vectors = zip(*((node, vector) for _, _, node, vector in rows), strict=True)
            ids = np.array(ids)
            a, b = pruned_edges(_unit(vectors))
            bounds = pa.array(np.searchsorted(a, np.arange(len(ids) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(bounds, pa.array(ids[b]))], names=["node", "near"])

    parted = members.select("shard", "part", "node", "vector").repartition("shard", "part").sortWithinPartitions("shard", "part", "node")
    lists = parted.mapInArrow(run, "node bigint, near array<bigint>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a row per shard of the node


def _search(members: DataFrame, graph: DataFrame, threshold: float, width: int) -> DataFrame:
    """(node, links, joins): copies of other nodes found, and links that connect what was not connected in its task."""
    held = members.join(graph, "node").select("shard", "part", F.lit(0).alias("role"), "node", "copies", "vector", "near")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asked = members.where("home").select("shard", part, F.lit(1).alias("role"), "node", "copies", "vector", F.lit(None).cast("array<bigint>").alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 2):
            rest = (r[2:] for r in rows)
            ids, copies, vectors, lists, first = [], [], [], [], None
            for role, node, n, vector, near in rest:
                if role:
                    first = (role, node, n, vector, near)
                    break
                ids.append(node)
                copies.append(n)
                vectors.append(vector)
                lists.append(np.array(near, dtype=np.int64))
            if not ids or first is None:
                continue
            x, ids, weight = _unit(vectors), np.array(ids), np.array(copies)  # ordered by node
            a, near = np.repeat(np.arange(len(ids)), [len(v) for v in lists]), np.concatenate(lists)
            b = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            here = ids[b] == near
            a, b = a[here], b[here]
            seeds = medoids(x, a, b, threshold)
            place = {node: i for i, node in enumerate(ids.tolist())}
            group = np.arange(len(ids))  # of each member, as far as links connect it
            queries = chain([first], rest)
            while block := list(islice(queries, BLOCK)):
                met = greedy_search(_unit([q[3] for q in block]), x, a, b, seeds, threshold, width) >= threshold
                out = []
                for (_, node, *_), hit in zip(block, met, strict=True):
                    own = place.get(node)
                    if own is not None:
                        hit[own] = False
                    others = np.flatnonzero(hit)
                    known, at = np.unique(group[others], return_index=True)
                    new = known != group[own] if own is not None else np.ones(len(known), dtype=bool)
                    if new.any():
                        group[np.isin(group, known)] = group[own] if own is not None else known[0]
                    out.append((node, int(weight[others].sum()), ids[others[at[new]]].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["node", "links", "joins"])

    both = held.union(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "role", "node")
    found = both.mapInArrow(run, "node bigint, links bigint, joins array<bigint>")
    return found.groupBy("node").agg(F.sum("links").alias("links"), F.flatten(F.collect_list("joins")).alias("joins"))  # a row per part of its shard


def exact_links(nodes: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(node, exact): copies of other nodes at the threshold or more, by brute force, for the few nodes of ``queries``."""
    sample = queries.select("node", "vector").toArrow()
    shared = nodes.sparkSession.sparkContext.broadcast((np.array(sample.column(0).to_pylist()), _unit(sample.column(1).combine_chunks())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            hit = (q @ _unit(batch.column(2)).T >= threshold) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
            total += hit @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "exact"])

    return nodes.select("node", "copies", "vector").mapInArrow(count, "node bigint, exact bigint").groupBy("node").agg(F.sum("exact").alias("exact"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", audited: int = AUDITED) -> DataFrame:
    """Each vector with its links and component, and the recall of links that the audit measured (1 where there are none)."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vector", lambda v: v != 0)
    valid = F.coalesce(finite, F.lit(False))
    distinct = rows.where(valid).groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = stage(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("vector")))
    sizes = nodes.groupBy("size").count().limit(MAX_LENGTHS + 1).collect()
    if len(sizes) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} lengths of vectors")
    parts, recalls = [], []
    for size, n in sizes:
        own = nodes.where(F.col("size") == size)
        sample = own.orderBy(F.xxhash64("vector", F.lit(1))).limit(audited)
        exact = stage(exact_links(own, sample, threshold))
        centres, times = _centres(own, n), 1
        while True:
            shards = _members(own, centres, OVERLAP * times)
            found = stage(_search(shards, stage(_graph(shards)), threshold, WIDTH * times))
            audit = exact.join(found, "node").agg(F.sum("exact"), F.sum(F.least("exact", "links"))).first()
            if not audit[0] or audit[1] >= LEAST_RECALL * audit[0] or OVERLAP * times >= len(centres):
                break
            times *= 3
        parts.append(found)
        recalls.append((audit[0] or 0, audit[1] or 0))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(1.0).alias("audit_recall"))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    groups = components(found.select(F.col("node").alias("a"), F.explode("joins").alias("b")))
    least = groups.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("group_id"))
    grouped = groups.join(least, "component").select("node", "group_id")
    named = nodes.select("node", "vector", "copies", "least").join(found.select("node", "links"), "node", "left").join(grouped, "node", "left")
    named = named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("group_id", "least").alias("group_id"))
    exact, got = sum(e for e, _ in recalls), sum(g for _, g in recalls)
    joined = rows.withColumn("_key", F.when(valid, F.col("vector"))).drop("vector").join(named, F.col("_key") == F.col("vector"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("group_id", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"), F.lit(got / exact if exact else 1.0).alias("audit_recall"),
    )
