"""Conversation structure repair: a cost DP over edits, and prefix-doubling ranks that pick the least audit.

The rows of a conversation, in order of turn, are edited so that the initials of their roles read ``(s?(ua)+)?``. Edits and
costs: Keep 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert an empty user or assistant
row 3; a truncated row that stays adds 3. The audit is the string of the edits' initials; of the cheapest ones the least wins.

*Cost DP.* A node is (rows consumed, state), the states being those of the pattern; costs to the end are found from the last row back.
*Ranks.* Each node keeps its optimal arc of least letter (the letters of a node's arcs lead to different nodes of the same
pattern, so this is one pointer). Ranks of all nodes by their first letter become ranks by 2, 4, 8, ... letters: the rank of
a node and of the node that its doubled pointer reaches. The three roots (nothing kept, with and without a system row) are compared by
cost, then by rank, and the audit is read off the root through the doubled pointers.

*Distribution.* Rows are range-partitioned by (conversation, turn, ...), so a conversation of any size lies in neighbouring tasks. A
conversation inside one task is solved there, in batches. One that reaches an edge of its task, or ``PIECE_ROWS`` rows or ``PIECE_CHARS``
characters, is cut into pieces. Per piece a 5 x 5 matrix of costs is found; the matrices (a few numbers for each piece) are read per conversation from the
last to the first to give each piece its costs to the end; the pieces are solved in parallel for each state that may enter; a second
reading combines their ranks and a third hands on the state. Audits compare piece by piece, as an Insert before a row belongs to the row's piece.

Defined results: nulls in role and text are one space, and in the damage key too; a null id is one conversation; equal turns are ordered by role, then
text; an empty role, or one of another initial, can't be kept; conversations without rows have zeros and an empty audit; an empty table
gives no rows; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..runtime import stage

PIECE_ROWS, PIECE_CHARS, BATCH_ROWS = 16_384, 8_000_000, 4_000
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: States: nothing kept for good, a system row is due, a user row is due, an assistant row is due, a pair is complete.
NOTHING, SYSTEM, OPEN, USER, PAIR = range(5)
ROOTS = (NOTHING, SYSTEM, OPEN)
INF = 1 << 60
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = "\0DIKR"
_SPACE = " \t\n\x0b\x0c\r"
_TURNS = {OPEN: USER, PAIR: USER, USER: PAIR}

ROW = "struct<turn:bigint,role:string,text:string,present:boolean>"
STATS = "struct<n:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,first:string,last:string,low:bigint,high:bigint,turns:bigint,first_turn:bigint,last_turn:bigint>"
_STATS = ("n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "first_turn", "last_turn")
REPAIRED = "array<struct<role:string,text:string>>"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after the stated damage: (conv_id, turn, role, text, present); a dropped row stays as one that is not present."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), times.alias("_copy")).drop("_copy")


def faults(rows: list[tuple], repeated: set[int] | None = None) -> list[int]:
    """The first fault of each row (turn, role, text, ...). ``repeated`` names the duplicates where the rows are part of a conversation."""
    seen: set[tuple[str, str]] = set()
    out = []
    for i, row in enumerate(rows):
        body = row[2].rstrip(_SPACE)
        again = i in repeated if repeated is not None else (row[1], row[2]) in seen
        if repeated is None:
            seen.add((row[1], row[2]))
        out.append(BLANK if not body else DUPLICATE if again else FINE if body[-1] in ".!?" else TRUNCATED)
    return out


def stats(rows: list[tuple], found: list[int]) -> tuple:
    """Counts of a run of rows, and what its neighbours need to know of its borders."""
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return (
        len(rows), found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED), _illegal(initials),
        initials[0] if rows else None, initials[-1] if rows else None,
        min(turns, default=None), max(turns, default=None), len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None,
    )


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def merged(a: tuple | None, b: tuple) -> tuple:
    """Counts of two neighbouring runs of rows."""
    if a is None or not a[0]:
        return b
    if not b[0]:
        return a
    low, high = [x for x in (a[7], b[7]) if x is not None], [x for x in (a[8], b[8]) if x is not None]
    both = a[11] is not None and a[11] == b[10]
    return (
        a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] + b[4] + _illegal([a[6], b[5]]), a[5], b[6],
        min(low, default=None), max(high, default=None), a[9] + b[9] - both, a[10] if a[10] is not None else b[10], b[11] if b[11] is not None else a[11],
    )


def costs(initials: list[str], found: list[int], end: list[int], last: bool) -> list[list[int]]:
    """Cheapest cost to the end from each (rows consumed, state). ``end`` has the costs after the rows."""

    def inserted(c: list[int]) -> list[int]:
        c[USER], c[PAIR] = min(c[USER], INSERT + c[PAIR]), min(c[PAIR], INSERT + c[USER])
        c[OPEN] = min(c[OPEN], INSERT + c[USER])
        return c

    after = inserted(list(end)) if last else list(end)
    out = [after]
    for initial, fault in zip(reversed(initials), reversed(found)):
        now = [DELETE + c for c in after]
        if fault in (FINE, TRUNCATED):
            more = CUT_SHORT if fault == TRUNCATED else 0
            if initial == "s":
                now[SYSTEM] = min(now[SYSTEM], KEEP + more + after[OPEN])
            for state, to in _TURNS.items():
                price = KEEP if initial == ("u" if to == USER else "a") else REROLE
                now[state] = min(now[state], price + more + after[to])
        out.append(after := inserted(now))
    return out[::-1]


def arcs(initials: list[str], found: list[int], table: list[list[int]], last: bool, base: int) -> tuple[list[int], list[int]]:
    """For each node: the least letter among its optimal arcs and the node it leads to; ends lead to themselves."""
    letters, to_node = [], []
    for i, now in enumerate(table):
        end = i == len(initials)
        after = now if end else table[i + 1]
        here = base + 5 * i
        for state in range(5):
            cost, pick, to = now[state], 0, here + state
            if cost < INF:
                fault = None if end else found[i]
                more = CUT_SHORT if fault == TRUNCATED else 0
                kept = fault in (FINE, TRUNCATED)
                target = _TURNS.get(state)
                if not end and cost == DELETE + after[state]:
                    pick, to = 1, here + 5 + state
                elif target is not None and (not end or last) and cost == INSERT + now[target]:
                    pick, to = 2, here + target
                elif kept and state == SYSTEM:
                    pick, to = 3, here + 5 + OPEN
                elif kept and target is not None:
                    pick, to = (3 if initials[i] == ("u" if target == USER else "a") else 4), here + 5 + target
            letters.append(pick)
            to_node.append(to)
    return letters, to_node


class Paths:
    """Ranks and doubled pointers of a set of nodes, over audits of any length."""

    def __init__(self, letters: list[int], to_node: list[int], longest: int) -> None:
        self.letters = np.array(letters, dtype=np.int64)
        self.pointers = [np.array(to_node, dtype=np.int64)]
        rank = self.letters
        while (1 << (len(self.pointers) - 1)) < longest:
            pointer = self.pointers[-1]
            # the rank by twice as many letters: own rank, then the rank of the node that those letters reach
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer], return_inverse=True)[1]
            self.pointers.append(pointer[pointer])
        self.rank = rank

    def read(self, nodes: list[int]) -> list[tuple[str, int]]:
        """(audit, last node) of the paths that start at ``nodes``."""
        path = np.array(nodes, dtype=np.int64)[:, None]
        for pointer in self.pointers[:-1]:
            path = np.concatenate([path, pointer[path]], axis=1)
        path = np.concatenate([path, self.pointers[-1][path[:, :1]]], axis=1)
        picked = self.letters[path]
        sizes = (picked > 0).sum(axis=1)
        return [("".join(LETTERS[x] for x in row[:n]), int(at[n])) for row, n, at in zip(picked.tolist(), sizes.tolist(), path.tolist())]


def applied(rows: list[tuple], audit: str, state: int = OPEN) -> list[dict]:
    """The repaired rows that an audit gives; ``state`` is the one that enters."""
    out, i, due = [], 0, "assistant" if state == USER else "user"
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        row = rows[i] if letter != "I" else None
        i += letter != "I"
        role = row[1] if letter == "K" else due
        out.append({"role": role, "text": row[2] if row else ""})
        due = "assistant" if role[:1] == "u" else "user"
    return out


def solve(conversations: list[list[tuple]]) -> list[tuple[tuple, int, str, list[dict]]]:
    """(counts, cost, audit, repaired rows) of whole conversations, each a list of (turn, role, text)."""
    letters: list[int] = []
    to_node: list[int] = []
    known = []
    for rows in conversations:
        found = faults(rows)
        initials = [r[1][:1] for r in rows]
        table = costs(initials, found, [0, INF, INF, INF, 0], True)
        base = len(letters)
        more = arcs(initials, found, table, True, base)
        letters += more[0]
        to_node += more[1]
        known.append((rows, stats(rows, found), table[0], base))
    paths = Paths(letters, to_node, 3 * max(map(len, conversations), default=0) + 3)
    roots = [min((table[s], int(paths.rank[base + s]), base + s) for s in ROOTS) for _, _, table, base in known]
    read = paths.read([r[2] for r in roots])
    return [(counts, root[0], audit, applied(rows, audit)) for (rows, counts, _, _), root, (audit, _) in zip(known, roots, read)]


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        step = max(1, min(1_000, batch.num_rows * 4_000_000 // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def _arrow(fields: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(fields))


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int] = lambda r: 1) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > 2_000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


def _named(counts: tuple) -> dict:
    return dict(zip(_STATS, counts))


def _plain(counts: dict) -> tuple:
    return tuple(counts[k] for k in _STATS)


def _scanned(rows: DataFrame) -> DataFrame:
    """Solved conversations, and pieces of those that reach an edge of their task or are too long for one piece."""
    fields = f"conv_id bigint, part int, piece int, solved boolean, stats {STATS}, cost bigint, audit string, repaired {REPAIRED}, rows array<{ROW}>"
    piece_rows, piece_chars, batch_rows, schema = PIECE_ROWS, PIECE_CHARS, BATCH_ROWS, _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            waiting: list[tuple] = []
            size = 0

            def solved() -> Iterator[tuple]:
                bodies = [[r[:3] for r in rows if r[3]] for _, _, rows in waiting]
                for (conv, part, _), (counts, cost, audit, out) in zip(waiting, solve(bodies)):
                    yield conv, part, 0, True, _named(counts), cost, audit, out, None

            stream = groupby(_tuples(batches), key=lambda r: (r[0], r[1]))
            pending = None  # the conversation read last: an edge of the task only if none follows
            first = True
            for (conv, part), group in stream:
                if pending:
                    waiting.append(pending)
                    size += len(pending[2])
                    # a long conversation would pad the paths of many short ones, so it is solved by itself
                    if size >= batch_rows or len(pending[2]) > 256:
                        yield from solved()
                        waiting, size = [], 0
                pending, held, chars, piece = None, [], 0, 0
                for row in group:
                    held.append(row[2:])
                    chars += len(row[4])
                    if len(held) >= piece_rows or chars >= piece_chars:
                        yield conv, part, piece, False, None, None, None, None, [dict(zip(("turn", "role", "text", "present"), r)) for r in held]
                        held, chars, piece = [], 0, piece + 1
                if piece or first:
                    if held:
                        yield conv, part, piece, False, None, None, None, None, [dict(zip(("turn", "role", "text", "present"), r)) for r in held]
                else:
                    pending = (conv, part, held)
                first = False
            if waiting:
                yield from solved()
            if pending:
                conv, part, held = pending
                yield conv, part, 0, False, None, None, None, None, [dict(zip(("turn", "role", "text", "present"), r)) for r in held]

        yield from _batches(found(), schema, lambda r: 1 + len(r[8] or ()) + len(r[7] or ()))

    order = ["conv_id", "turn", "role", F.substring("text", 1, 32)]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "role", "text")
    return stage(dealt.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "present").mapInArrow(run, fields))


def _streamed(pieces: DataFrame, walk: Callable, fields: str, descending: bool) -> DataFrame:
    """The pieces of each conversation in order, one after the other, through ``walk`` (a generator over rows), which holds a few numbers."""
    schema = _arrow(fields)
    by = [F.col(c).desc() if descending else F.col(c) for c in ("part", "piece")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_groups() -> Iterator[tuple]:
            for _, group in groupby(_tuples(batches), key=lambda r: r[0]):
                yield from walk(group)

        yield from _batches(all_groups(), schema)

    return stage(pieces.repartition("conv_id").sortWithinPartitions("conv_id", *by).mapInArrow(run, fields))


def _pieces_solved(cut: DataFrame) -> DataFrame:
    """Pieces of long conversations with their audits and repaired rows."""
    at = ["conv_id", "part", "piece"]
    rows = cut.select(*at, F.posexplode(F.filter("rows", lambda r: r["present"])).alias("i", "r")).select(*at, "i", F.sha2(F.concat("r.role", F.lit("\0"), "r.text"), 256).alias("h"))
    place = F.struct("part", "piece", "i")
    first = rows.groupBy("conv_id", "h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("conv_id", "c").withColumnRenamed("h", "g")
    again = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g"))).where(place > F.col("first"))
    again = again.groupBy(*at).agg(F.collect_list("i").alias("repeated"))
    again = again.select(*(F.col(c).alias(f"_{c}") for c in at), "repeated")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("piece") == F.col("_piece"))
    bodies = F.transform(F.filter("rows", lambda r: r["present"]), lambda r: F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["text"].alias("text"))).alias("rows")

    fields = f"conv_id bigint, part int, piece int, rows array<struct<turn:bigint,role:string,text:string>>, faults array<int>, matrix array<bigint>, stats {STATS}"

    schema1 = _arrow(fields)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv, part, piece, held, repeated in _tuples(batches):
                body = [(r["turn"], r["role"], r["text"]) for r in held]
                found = faults(body, set(repeated or ()))
                initials = [r[1][:1] for r in body]
                matrix = [costs(initials, found, [0 if s == e else INF for s in range(5)], False)[0] for e in range(5)]
                yield conv, part, piece, held, found, [min(c, INF) for e in matrix for c in e], _named(stats(body, found))

        yield from _batches(each(), schema1, lambda r: 1 + len(r[3]))

    known = stage(cut.join(again, same, "left").select(*at, bodies, "repeated").mapInArrow(measured, fields))

    def to_the_end(group: Iterator[tuple]) -> Iterator[tuple]:
        after = None
        for conv, part, piece, matrix in group:
            last = after is None
            after = costs([], [], [0, INF, INF, INF, 0], True)[0] if last else after
            yield conv, part, piece, after, last
            after = [min(min(matrix[5 * e + s] + after[e] for e in range(5)), INF) for s in range(5)]

    ends = _streamed(known.select(*at, "matrix"), to_the_end, "conv_id bigint, part int, piece int, after array<bigint>, last boolean", True)
    ends = ends.select(*(F.col(c).alias(f"_{c}") for c in at), "after", "last")
    fields2 = f"conv_id bigint, part int, piece int, stats {STATS}, starts array<bigint>, audits array<string>, exits array<int>, ranks array<bigint>"

    schema2 = _arrow(fields2)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv, part, piece, roles, found, counts, after, last in _tuples(batches):
                initials = [r[:1] for r in roles]
                table = costs(initials, found, [0, INF, INF, INF, 0] if last else after, last)
                paths = Paths(*arcs(initials, found, table, last, 0), 3 * len(found) + 3)
                read = paths.read(list(range(5)))
                yield conv, part, piece, counts, [min(c, INF) for c in table[0]], [a for a, _ in read], [e % 5 for _, e in read], paths.rank[:5].tolist()

        yield from _batches(each(), schema2, lambda r: 500)

    roles = F.transform("rows", lambda r: r["role"])
    tried = stage(known.join(ends, same).select(*at, roles.alias("roles"), "faults", "stats", "after", "last").mapInArrow(ranked, fields2))

    def root(group: Iterator[tuple]) -> Iterator[tuple]:
        place = None
        for conv, _, _, starts, exits, ranks in group:
            # places of the five states by the audits from here to the end: those of this piece, then those of the next
            keys = [(ranks[s], place[exits[s]] if place else 0) for s in range(5)]
            order = {k: i for i, k in enumerate(sorted(set(keys)))}
            place = [order[k] for k in keys]
        cost, _, state = min((starts[s], place[s], s) for s in ROOTS)
        yield conv, state, cost

    roots = _streamed(tried.select(*at, "starts", "exits", "ranks"), root, "conv_id bigint, root int, cost bigint", True)
    roots = roots.withColumnRenamed("conv_id", "_conv_id")

    def handed_on(group: Iterator[tuple]) -> Iterator[tuple]:
        state = None
        for conv, part, piece, exits, start, cost in group:
            head = state is None
            state = start if head else state
            yield conv, part, piece, state, cost if head else 0
            state = exits[state]

    entered = tried.select(*at, "exits").join(F.broadcast(roots) if roots.count() < 100_000 else roots, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).drop("_conv_id")
    entered = _streamed(entered, handed_on, "conv_id bigint, part int, piece int, state int, cost bigint", False)
    entered = entered.select(*(F.col(c).alias(f"_{c}") for c in at), "state", "cost")
    picked = tried.join(entered, same).select(*(F.col(c).alias(f"_{c}") for c in at), "stats", "state", "cost", F.element_at("audits", F.col("state") + 1).alias("audit"))
    fields3 = f"conv_id bigint, part int, piece int, stats {STATS}, cost bigint, audit string, repaired {REPAIRED}"

    schema3 = _arrow(fields3)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv, part, piece, held, counts, state, cost, audit in _tuples(batches):
                yield conv, part, piece, counts, cost, audit, applied([(r["turn"], r["role"], r["text"]) for r in held], audit, state)

        yield from _batches(each(), schema3, lambda r: 1 + len(r[6]))

    bodies = known.select(*at, "rows").join(picked, same).select(*at, "rows", "stats", "state", "cost", "audit")
    return stage(bodies.mapInArrow(rebuilt, fields3))


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations, in pieces: (conv_id, part, piece, pieces, stats, cost, audit, repaired).

    ``rows`` has (conv_id, turn, role, text, present), ``present`` being false for rows that only say that the conversation exists. Nearly every conversation is one
    piece; ``repaired`` holds its rows in order. The cost of a conversation stands in its first piece.
    """
    found = _scanned(rows)
    cut = found.where("NOT solved").drop("stats", "cost", "audit", "repaired", "solved")
    parts = _pieces_solved(cut).withColumn("whole", F.lit(False))
    whole = found.where("solved").select("conv_id", "part", "piece", "stats", "cost", "audit", "repaired", F.lit(True).alias("whole"))
    return whole.unionByName(parts)


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """One row for each repaired row, in order of (part, piece, at)."""
    return pieces.select("conv_id", "part", "piece", F.posexplode("repaired").alias("at", "r")).select("conv_id", "part", "piece", "at", "r.role", "r.text")


def digest(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, cost, audit and the SHA-256 of its repaired rows.

    The hash of a conversation in one piece is an expression; those in several are read in order, one piece after the other.
    """
    lines = F.concat_ws("\n", F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])))
    columns = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def walk(group: Iterator[tuple]) -> Iterator[tuple]:
        total, counts, audits, hashed, begun = 0, None, [], hashlib.sha256(), False
        for conv, _, _, own, cost, audit, body, n in group:
            counts, total = merged(counts, _plain(own)), total + cost
            audits.append(audit)
            if n:
                hashed.update((b"\n" if begun else b"") + body.encode("utf-8", "surrogatepass"))
                begun = True
        gaps = counts[8] - counts[7] + 1 - counts[9] if counts[7] is not None else 0
        yield conv, gaps, *counts[1:5], total, "".join(audits), hashed.hexdigest()

    gaps = F.coalesce(F.col("stats.high") - F.col("stats.low") + 1 - F.col("stats.turns"), F.lit(0)).alias("gaps")
    numbers = [F.col(f"stats.{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    one = pieces.where("whole").select("conv_id", gaps, *numbers, "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    several = pieces.where("NOT whole").select("conv_id", "part", "piece", "stats", "cost", "audit", lines.alias("body"), F.size("repaired").alias("n"))
    return one.union(_streamed(several, walk, columns, False))
