"""Conversation prefix trie: double arrays per prefix shard, and shared upper nodes merged globally.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. Turns are 128-bit
hashes from the first step on, and a node's key is a hash of its turns.

*Shards.* Equal conversations are one entry with a weight. Entries are range-partitioned by their first turns and sorted by all of them, so
each shard (a run of bounded size) is a range of prefixes, whatever turn is common: only nodes on the paths of a shard's first and last
entry can also lie in another shard.
*Double array.* The turns of a shard get dense ids; for each node BASE is placed first-fit so that CHECK[BASE + id] is free for the ids of
all its children. The entries are then traversed through BASE and CHECK to count members, and subtree sums go up along CHECK.
*Merge.* Nodes that one shard owns are final. Shared ones are partial sums that a grouped aggregate unites. Each shared node is counted on
the path of the least conversation through it, and a running sum from the end of each path gives every ancestor its subtree.

A conversation of more than ``DEPTH`` turns is cut into blocks of so many; a block is an entry below the node that the blocks before it lead to, and all
nodes on such paths are merged globally, so no conversation is gathered in one task.

Defined results: null roles and texts are empty; null turns come first, and equal turns are ordered by role, then text; rows with a null conv_id belong to
no conversation and are left out; repeated rows are turns of their own; an empty table has no root; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import ordered_scan, running_sum
from ..runtime import stage
from .repair import _arrow, _batches, _tuples

#: Turns of an entry at most, turns of a shard (the last entry may exceed it), ids in one piece of a member list.
DEPTH, SHARD_TURNS, LIST_IDS = 4_096, 100_000, 10_000
#: Turns that are sort keys of the range partitioning.
SORT_TURNS = 8
HEAD = 3
ROOT = bytes(16)
TURN = "struct<h:binary,w:int>"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_hash(role: str, text: str) -> bytes:
    name = role.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_128_digest(len(name).to_bytes(4, "little") + name + text.encode("utf-8", "surrogatepass"))


def chain(local: bytes, turn: bytes) -> bytes:
    return xxhash.xxh3_128_digest(local + turn)


def node_key(start: bytes, local: bytes) -> bytes:
    """Key of a node ``local`` (a chain of turns) below ``start``; an empty chain is ``start`` itself."""
    return start if local == ROOT else xxhash.xxh3_128_digest(start + local)


class DoubleArray:
    """A trie of sequences of ids (1 and more) in the arrays BASE and CHECK; state 0 is the root."""

    def __init__(self, sequences: list[list[int]]) -> None:
        """``sequences`` are sorted by any order that keeps equal prefixes together."""
        self.base, self.check = [0], [-2]
        self._after = [1]  # for each slot a slot at or after it from which the search for a free one goes on
        self.order = [0]  # states, parents first
        waiting = [(0, 0, len(sequences), 0)]
        for state, low, high, depth in waiting:
            while low < high and len(sequences[low]) == depth:
                low += 1
            children = []
            while low < high:
                first, upto = sequences[low][depth], low + 1
                while upto < high and sequences[upto][depth] == first:
                    upto += 1
                children.append((first, low, upto))
                low = upto
            if children:
                base = self._fit(sorted(c[0] for c in children))
                self.base[state] = base
                for first, a, b in children:
                    self.check[base + first] = state
                    self._after[base + first] = base + first + 1
                    self.order.append(base + first)
                    waiting.append((base + first, a, b, depth + 1))

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            self._after += range(len(self.base), size)
            self.base += [0] * more
            self.check += [-1] * more

    def _free(self, slot: int) -> int:
        """The first free slot at or after ``slot``."""
        self._grow(slot + 1)
        at = slot
        while at < len(self._after) and self._after[at] != at:
            at = self._after[at]
        self._grow(at + 1)
        while self._after[slot] != at and slot != at:
            self._after[slot], slot = at, self._after[slot]
        return at

    def _fit(self, ids: list[int]) -> int:
        slot = self._free(ids[0])
        while True:
            base = slot - ids[0]
            self._grow(base + ids[-1] + 1)
            if all(self.check[base + i] == -1 for i in ids):
                return base
            slot = self._free(slot + 1)

    def step(self, state: int, turn: int) -> int:
        """The child of ``state`` by ``turn``, or -1."""
        to = self.base[state] + turn
        return to if to < len(self.check) and self.check[to] == state else -1


NODE = (
    "kind int, key binary, parent binary, depth bigint, conv_id bigint, parent_conv bigint, n bigint, children bigint, "
    "leaves bigint, saved bigint, words bigint, end_n bigint, end_least bigint, path bigint"
)
OWNED, SHARED, ON_PATH = range(3)


def shard_nodes(start: bytes, block: int, entries: list[tuple[int, int, list[dict], bool, bool]], depth: int) -> Iterator[tuple]:
    """Rows of ``NODE`` for one shard below ``start``: entries are (conv_id, weight, turns, whether it ends here, whether it has more blocks)."""
    dense: dict[bytes, int] = {}
    sequences = [[dense.setdefault(t["h"], len(dense) + 1) for t in turns] for _, _, turns, _, _ in entries]
    trie = DoubleArray(sequences)
    size = len(trie.base)
    n, least, words, local, level = [0] * size, [None] * size, [0] * size, [ROOT] * size, [0] * size
    end_n, end_least, shared = [0] * size, [None] * size, [False] * size
    shared[0] = True
    below = block > 0  # the block before counts the root of a later block
    for at, ((conv, weight, turns, ends, many), sequence) in enumerate(zip(entries, sequences)):
        state = 0
        path = [0]
        for turn, number in zip(turns, sequence):
            to = trie.step(state, number)
            if local[to] == ROOT:
                local[to], level[to], words[to] = chain(local[state], turn["h"]), level[state] + 1, turn["w"]
            path.append(state := to)
        for s in path[below:]:
            n[s] += weight
            least[s] = conv if least[s] is None else min(conv, least[s])
        if ends:
            end_n[state] += weight
            end_least[state] = conv if end_least[state] is None else min(conv, end_least[state])
        if many or at in (0, len(entries) - 1):
            for s in path:
                shared[s] = True
            for s in path[below:]:
                yield ON_PATH, node_key(start, local[s]), None, depth + level[s], None, None, None, None, None, None, None, None, None, conv
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for s in reversed(trie.order[1:]):
        parent = trie.check[s]
        if not shared[s]:
            leaves[s] += children[s] == 0
            saved[s] += (n[s] - 1) * words[s]
            children[parent] += 1
            leaves[parent] += leaves[s]
            saved[parent] += saved[s]
    for s in trie.order:
        parent = trie.check[s] if s else None
        above = None if parent is None else node_key(start, local[parent])
        known = least[parent] if parent is not None and not shared[parent] else None
        kind = SHARED if shared[s] else OWNED
        yield kind, node_key(start, local[s]), above, depth + level[s], least[s], known, n[s], children[s], leaves[s], saved[s], words[s], end_n[s], end_least[s], None


def _mapped(df: DataFrame, each: Callable[[Iterator[tuple]], Iterator[tuple]], fields: str, weight: Callable[[tuple], int] = lambda r: 1) -> DataFrame:
    schema = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(each(_tuples(batches)), schema, weight)

    return df.mapInArrow(run, fields)


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, piece, whole, turns): conversations in order as hashes, in pieces where they reach an edge of a task or are long."""
    limit = DEPTH - HEAD
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *text).where("conv_id IS NOT NULL")
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, first = None, True
        for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
            if last:
                yield last
            last, held, piece = None, [], 0
            for _, _, role, text in group:
                if len(held) == limit:
                    yield conv, part, piece, False, held
                    held, piece = [], piece + 1
                held.append({"h": turn_hash(role, text), "w": len(text.encode("utf-8", "surrogatepass").split())})
            if first or piece:
                yield conv, part, piece, False, held
            else:
                last = (conv, part, 0, True, held)
            first = False
        if last:
            yield *last[:3], False, last[4]

    fields = f"conv_id bigint, part int, piece int, whole boolean, turns array<{TURN}>"
    return stage(_mapped(dealt.select("conv_id", F.spark_partition_id().alias("part"), "role", "text"), each, fields, lambda r: len(r[4])))


def _in_order(df: DataFrame, walk: Callable[[Iterator[tuple]], Iterator[tuple]], fields: str, *order: str) -> DataFrame:
    """Narrow rows of each conversation in order, through a generator that holds a few numbers."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, key=lambda r: r[0]):
            yield from walk(group)

    return stage(_mapped(df.repartition("conv_id").sortWithinPartitions("conv_id", *order), each, fields))


def head_turns(conv: Column) -> Column:
    """How many turns conversation ``conv`` takes over: crc32 of its number in decimals, modulo 4."""
    return (F.crc32(conv.cast("string")) % 4).cast("int")


def family(conv: Column) -> Column:
    return conv - conv % 20


def _rebuilt(pieces: DataFrame) -> DataFrame:
    """(conv_id, block, turns, blocks): the rebuilt conversations in blocks of ``DEPTH`` turns."""
    whole = pieces.where("whole").select("conv_id", "turns")
    cut = pieces.where("NOT whole")

    def starts(group: Iterator[tuple]) -> Iterator[tuple]:
        at = 0
        for conv, part, piece, size in group:
            yield conv, part, piece, at
            at += size

    begins = _in_order(cut.select("conv_id", "part", "piece", F.size("turns").alias("size")), starts, "conv_id bigint, part int, piece int, start bigint", "part", "piece")
    rows = cut.join(begins, ["conv_id", "part", "piece"]).select("conv_id", "start", F.posexplode("turns").alias("i", "t")).select("conv_id", (F.col("start") + F.col("i")).alias("i"), "t")
    rows = stage(rows)
    own = F.col("conv_id") == family(F.col("conv_id"))
    first = rows.where((F.col("i") < HEAD) & own).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("s"))
    heads = whole.where(own).select("conv_id", F.slice("turns", 1, HEAD).alias("head")).union(first.select("conv_id", F.transform("s", lambda s: s["t"])))
    heads = heads.withColumnRenamed("conv_id", "family")
    taken = head_turns(F.col("conv_id"))
    head = F.slice(F.coalesce("head", F.array().cast(f"array<{TURN}>")), 1, F.col("taken"))

    def with_head(df: DataFrame) -> DataFrame:
        return df.withColumns({"family": family(F.col("conv_id")), "taken": taken}).join(heads, "family", "left").withColumn("head", head)

    rest = F.filter("turns", lambda t, i: i >= F.col("taken"))
    short = with_head(whole).select("conv_id", F.lit(0).cast("bigint").alias("block"), F.concat("head", rest).alias("turns"), F.lit(1).cast("bigint").alias("blocks"))

    known = stage(with_head(cut.select("conv_id").distinct()).select("conv_id", "taken", "head"))
    kept = rows.join(known.select("conv_id", "taken", F.size("head").alias("size")), "conv_id").where(F.col("i") >= F.col("taken"))
    kept = kept.select("conv_id", (F.col("i") - F.col("taken") + F.col("size")).alias("i"), "t")
    long = kept.union(known.select("conv_id", F.posexplode("head").alias("i", "t")))
    long = long.groupBy("conv_id", F.floor(F.col("i") / DEPTH).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("s"))
    long = stage(long.select("conv_id", "block", F.transform("s", lambda s: s["t"]).alias("turns")))
    counted = known.select("conv_id").join(long.groupBy("conv_id").agg(F.count("*").alias("blocks")), "conv_id", "left")
    # a cut conversation may keep no turn at all
    bare = counted.where("blocks IS NULL").select("conv_id", F.lit(0).cast("bigint").alias("block"), F.array().cast(f"array<{TURN}>").alias("turns"), F.lit(1).cast("bigint").alias("blocks"))
    long = long.join(counted, "conv_id").select("conv_id", "block", "turns", "blocks")
    return short.union(long).union(bare)


def _entries(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, turns, blocks, start, end): with the keys of the nodes at which a block starts and ends."""

    def local(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, block, turns, blocks in rows:
            at = ROOT
            for t in turns:
                at = chain(at, t["h"])
            yield conv, block, turns, blocks, at, node_key(ROOT, at)

    fields = f"conv_id bigint, block bigint, turns array<{TURN}>, blocks bigint, local binary, end binary"
    found = stage(_mapped(blocks, local, fields, lambda r: 1 + len(r[2])))
    one = found.where("blocks = 1").select("conv_id", "block", "turns", "blocks", F.lit(ROOT).alias("start"), "end")

    def keys(group: Iterator[tuple]) -> Iterator[tuple]:
        at = ROOT
        for conv, block, own in group:
            to = node_key(at, own)
            yield conv, block, at, to
            at = to

    many = found.where("blocks > 1")
    named = _in_order(many.select("conv_id", "block", "local"), keys, "conv_id bigint, block bigint, start binary, end binary", "block")
    return one.union(many.drop("local", "end").join(named, ["conv_id", "block"]).select("conv_id", "block", "turns", "blocks", "start", "end"))


def _member_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which more than one conversation ends, from (conv_id, key): their numbers ascending, read in order."""
    groups = ends.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    dealt = ends.join(groups, "key").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (key, part), group in groupby(rows, key=lambda r: r[:2]):
            held, piece = [], 0
            for _, _, conv in group:
                held.append(str(conv))
                if len(held) == LIST_IDS:
                    yield key, part, piece, ",".join(held)
                    held, piece = [], piece + 1
            if held:
                yield key, part, piece, ",".join(held)

    lists = _mapped(dealt.select("key", F.spark_partition_id().alias("part"), "conv_id"), joined, "conv_id binary, part int, piece int, ids string", lambda r: 1 + len(r[3]) // 100)

    def hashed(group: Iterator[tuple]) -> Iterator[tuple]:
        digest, begun = hashlib.sha256(), False
        for key, _, _, ids in group:
            digest.update((("," if begun else "") + ids).encode())
            begun = True
        yield key, digest.hexdigest()

    return _in_order(lists, hashed, "end_key binary, ends binary", "part", "piece").select("end_key", F.col("ends").cast("string").alias("listed"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    entries = stage(_entries(_rebuilt(_turns(conversations))))
    once = entries.where("blocks = 1").groupBy("end").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("turns").alias("turns"))
    once = once.select(F.lit(ROOT).alias("start"), F.lit(0).cast("bigint").alias("block"), "conv_id", "n", "turns", F.lit(True).alias("ends"), F.lit(False).alias("many"))
    many = entries.where("blocks > 1").select("start", "block", "conv_id", F.lit(1).cast("bigint"), "turns", F.col("block") == F.col("blocks") - 1, F.lit(True))
    keys = [F.get(F.col("turns"), F.lit(i))["h"].alias(f"k{i}") for i in range(SORT_TURNS)]
    hashes = F.transform("turns", lambda t: t["h"])
    dealt = once.union(many).repartitionByRange("start", *keys, "conv_id").sortWithinPartitions("start", hashes, "conv_id")
    depth, limit = DEPTH, SHARD_TURNS

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (start, block), group in groupby(rows, key=lambda r: r[:2]):
            held, size = [], 0
            for _, _, *entry in group:
                held.append(tuple(entry))
                size += 1 + len(entry[2])
                if size > limit:
                    yield from shard_nodes(start, block, held, block * depth)
                    held, size = [], 0
            if held:
                yield from shard_nodes(start, block, held, block * depth)

    found = stage(_mapped(dealt, each, NODE))
    merged = _merged(found)
    above = merged.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv"))
    owned = found.where(f"kind = {OWNED}").select(*merged.columns)
    inner, outer = owned.where("parent_conv IS NOT NULL"), owned.where("parent_conv IS NULL").union(merged)
    outer = outer.join(above, F.col("parent") == F.col("_key"), "left").withColumn("parent_conv", F.col("_conv")).select(*merged.columns)
    nodes = inner.union(outer)
    lists = _member_lists(entries.where(F.col("block") == F.col("blocks") - 1).select("conv_id", F.col("end").alias("key")))
    single = F.when(F.col("end_n") == 1, F.sha2(F.col("end_least").cast("string"), 256)).otherwise(_EMPTY)
    named = nodes.where("end_n > 1").join(lists, F.col("key") == F.col("end_key")).withColumn("ends_sha256", F.col("listed")).select(*merged.columns, "ends_sha256")
    nodes = nodes.where("end_n <= 1").select(*merged.columns, single.alias("ends_sha256")).union(named)
    return nodes.select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def _merged(found: DataFrame) -> DataFrame:
    """Shared nodes with their members, children and subtree sums united over all shards."""
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved", "end_n")]
    least = [F.min(c).alias(c) for c in ("conv_id", "end_least")]
    most = [F.max(c).alias(c) for c in ("parent", "depth", "words")]
    shared = stage(found.where(f"kind = {SHARED}").groupBy("key").agg(*sums, *least, *most))
    inside = shared.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("more")).withColumnRenamed("parent", "_key")
    paths = stage(found.where(f"kind = {ON_PATH}").select("path", "key", "depth").distinct())
    counted = paths.groupBy("key").agg(F.min("path").alias("counted")).withColumnRenamed("key", "_at")
    full = shared.join(inside, F.col("key") == F.col("_key"), "left").join(counted, F.col("key") == F.col("_at"))
    children = F.col("children") + F.coalesce("more", F.lit(0))
    full = full.withColumns({"children": children, "leaves": F.col("leaves") + (children == 0).cast("bigint"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("words")})
    full = stage(full.drop("_key", "_at", "more"))
    values = full.select("key", "counted", "leaves", "saved")
    own = F.col("path") == F.col("counted")
    values = paths.join(values, "key").select("path", "key", (-F.col("depth")).alias("up"), F.when(own, F.col("leaves")).alias("leaves"), F.when(own, F.col("saved")).alias("saved"))
    scanned = ordered_scan(values, ["path"], ["up"], F.floor(F.col("up") / 65_536), all_leaves=running_sum(F.col("leaves")), all_saved=running_sum(F.col("saved")))
    totals = scanned.groupBy("key").agg(F.sum("all_leaves").alias("leaves"), F.sum("all_saved").alias("saved"))
    done = full.drop("leaves", "saved", "counted").join(totals, "key")
    return stage(done.select("key", "parent", "depth", "conv_id", F.lit(None).cast("bigint").alias("parent_conv"), "n", "children", "leaves", "saved", "words", "end_n", "end_least"))


def oracle_sql() -> str:
    """The trie by whole prefixes: every prefix of every rebuilt conversation as a list of turns."""
    steps = "flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    return f"""
        WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM o),
             c AS (SELECT conv_id, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
             r AS (SELECT c.conv_id, 0 AS own, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i < h
                   UNION ALL SELECT c.conv_id, 1, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= h),
             d AS (SELECT conv_id, row_number() OVER w AS depth, text, list(role || chr(1) || text) OVER w AS turns FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
             k AS (SELECT conv_id, depth, text, sha256(array_to_string(turns, chr(2))) AS k, coalesce(lag(sha256(array_to_string(turns, chr(2)))) OVER (PARTITION BY conv_id ORDER BY depth), '') AS pk FROM d
                   UNION ALL SELECT conv_id, 0, '', '', NULL FROM c),
             len AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id),
             e AS (SELECT k.k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM k JOIN len USING (conv_id, depth) GROUP BY k.k),
             n AS (SELECT k, any_value(pk) AS pk, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words FROM k GROUP BY k),
             ch AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY pk),
             v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
             s AS (SELECT k.k, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n - 1) * words) AS saved
                   FROM k JOIN k AS x ON x.conv_id = k.conv_id AND x.depth >= k.depth JOIN v ON v.k = x.k AND v.conv_id = x.conv_id GROUP BY k.k)
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n AS n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM v LEFT JOIN n AS p ON p.k = v.pk JOIN s ON s.k = v.k LEFT JOIN e ON e.k = v.k"""
