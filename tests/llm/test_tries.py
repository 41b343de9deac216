"""The prefix trie against dictionaries of prefixes, with shards and blocks of all sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from tracelake.llm import tries


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: heads[c]] + x[heads[c] :] for c, x in own.items()}


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sorted(rebuilt(rows).items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def table(seed, n, longest, kinds=3):
    rnd = random.Random(seed)
    rows = []
    for conv in rnd.sample(range(3 * n), n):
        for turn in range(rnd.randrange(1, longest)):
            rows.append((conv, rnd.choice([turn, turn, turn, None]), rnd.choice(["user", None, "assistant"]) if rnd.random() < 0.1 else "user", f"a{' b' * rnd.randrange(kinds)}"))
    return rows


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return sorted(tuple(r[c] for c in NAMES) for r in tries.prefix_trie(frame).collect())


def test_shards(spark, monkeypatch):
    rows = table(1, 300, 9) + [(None, 1, "user", "lost"), (70_000, 0, "user", None)]
    assert got(spark, rows) == brute(rows)
    monkeypatch.setattr(tries, "SHARD_TURNS", 25)
    monkeypatch.setattr(tries, "LIST_IDS", 2)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("depth", [4, 6])
def test_blocks(spark, monkeypatch, depth):
    monkeypatch.setattr(tries, "DEPTH", depth)
    monkeypatch.setattr(tries, "SHARD_TURNS", 40)
    rows = table(depth, 60, 25, kinds=2)
    long = [(5_000 + i, t, "user", "x") for i in range(6) for t in range(40 + i % 3)]
    assert got(spark, rows + long) == brute(rows + long)


def test_copies_and_empty(spark):
    rows = [(conv, t, "user", f"word {t}") for conv in range(400) for t in range(5)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_sql_twin(spark):
    rows = table(8, 120, 8)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    found = duckdb.sql(f"SELECT {', '.join(NAMES)} FROM ({tries.oracle_sql()})").fetchall()
    assert sorted(found) == brute(rows)


def test_double_array():
    rnd = random.Random(2)
    words = sorted({tuple(rnd.randrange(1, 30) for _ in range(rnd.randrange(6))) for _ in range(500)})
    trie = tries.DoubleArray([list(w) for w in words])
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    assert len(trie.order) == len(set(trie.order)) == len(prefixes)
    assert sum(c >= 0 for c in trie.check) == len(prefixes) - 1

    def state(word):
        at = 0
        for i in word:
            at = trie.step(at, i)
            if at < 0:
                return at
        return at

    assert len({state(p) for p in prefixes}) == len(prefixes)
    for p in prefixes:
        for i in range(1, 31):
            assert (state((*p, i)) >= 0) == ((*p, i) in prefixes)


def test_extra_columns(spark):
    frame = spark.createDataFrame([(1, 2, "user", "A.", "x", 5)], "conv_id int, turn int, role string, text string, key string, n int")
    assert tries.prefix_trie(frame).count() >= 1
