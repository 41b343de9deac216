"""Conversation repair against a search of all edits, in one piece and in many."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tracelake.llm import repair

WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def searched(rows):
    """Uniform-cost search over (cost, audit) with the pattern as plain text."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WS)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, kept = heapq.heappop(queue)
        tail = ("s" if roles[:1] == "s" else "", roles[-1:], bool(roles))
        if (i, tail) in done:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return faults, cost, audit, kept
        done.add((i, tail))

        def legal(r):
            return any(re.fullmatch("(s?(ua)+)?", r + end) for end in ("", "a", "ua"))

        for role in ("user", "assistant"):
            if legal(roles + role[0]):
                heapq.heappush(queue, (cost + 3, audit + "I", i, roles + role[0], (*kept, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, roles, kept))
            if faults[i] not in ("b", "d"):
                more = 3 if faults[i] == "t" else 0
                if role[:1] and role[:1] in "sua" and legal(roles + role[:1]):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + role[:1], (*kept, (role, text))))
                for new in ("user", "assistant"):
                    if legal(roles + new[0]):
                        heapq.heappush(queue, (cost + more + 3, audit + "R", i + 1, roles + new[0], (*kept, (new, text))))
    raise AssertionError


def expected(rows):
    out = {}
    for conv, own in damaged(rows).items():
        faults, cost, audit, kept = searched(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def table(seed, n, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randrange(longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            if turn == 0 and rnd.random() < 0.5:
                role = "system"
            text = rnd.choice(["Yes.", "No!", "Why?\n", "so", "", "  ", None, f"Line {turn}.", "ä ö."])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    rnd.shuffle(rows)
    return rows


def got(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = repair.digest(repair.repair(repair.damage(frame))).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def test_many_short(spark):
    rows = table(1, 400, 9)
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(repair, "PIECE_ROWS", size)
    rows = table(2 + size, 30, 60)
    assert got(spark, rows) == expected(rows)


def test_hot_and_empty(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 100)
    rnd = random.Random(5)
    rows = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["A.", "B.", f"C{t}.", f"D{t}"])) for t in range(1_500)] + table(9, 40, 5)
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == {}


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1_000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    assert got(spark, [(3, turn, "user", "Hi.")]) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_least_audit_reads_doubled_pointers():
    body = [(0, "user", "A."), (1, "user", "B."), (2, "assistant", "C.")]
    [(_, cost, audit, out)] = repair.solve([body])
    assert (cost, audit) == (3, "KIKK")
    assert [r["role"] for r in out] == ["user", "assistant", "user", "assistant"]


def test_extra_columns(spark):
    frame = spark.createDataFrame([(1, 2, "user", "A.", "x", 5)], "conv_id int, turn int, role string, text string, part string, present int")
    assert repair.digest(repair.repair(repair.damage(frame))).count() == 1
