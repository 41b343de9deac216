"""Operators against plain Python on small inputs, and against their SQL twins on the smallest tables."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tracelake.operators import lens as L, problems as Pr, sessions as S
from tracelake.operators.ordered import last_seen, next_seen, ordered_scan, running_min, running_sum, sequence_chunk
from tracelake.schemas import SESSION_EVENT

SF = "/root/testdata/sf0.001"
FIELDS = [c.split()[0] for c in SESSION_EVENT.split(", ")]


def test_ordered_scan_equals_plain_windows(spark):
    rnd = random.Random(1)
    rows = [(f"k{rnd.randrange(3)}", i, rnd.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, x int")
    got = ordered_scan(
        df, ["k"], ["i"], sequence_chunk("i", 7), total=running_sum(F.col("x")), before=running_sum(F.col("x"), inclusive=False),
        prev=last_seen(F.col("x")), known=last_seen(F.col("x"), F.col("x").isNotNull(), inclusive=True), later=next_seen(F.col("i"), F.col("x") == 3), low=running_min(F.col("x")),
    )
    w = Window.partitionBy("k").orderBy("i")
    up, past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "*", F.coalesce(F.sum("x").over(up), F.lit(0)).alias("total"), F.coalesce(F.sum("x").over(past), F.lit(0)).alias("before"), F.lag("x").over(w).alias("prev"),
        F.last("x", True).over(up).alias("known"), F.min(F.when(F.col("x") == 3, F.col("i"))).over(ahead).alias("later"), F.min("x").over(up).alias("low"),
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def scan(events):
    """The problems of one session with one agent family, one event at a time."""
    out, used = [], set()
    for i, e in enumerate(events):
        kind = fails(e)
        if kind is None or i in used:
            continue
        external = kind == "error" and "429" in (e["error"] or "")
        if external:
            out.append((e["id"], kind, 1, None))
            continue
        attempts, signal = 1, None
        for j in range(i + 1, len(events)):
            c = events[j]
            if fails(c) == kind and (kind != "command-failure" or c["command"] == e["command"]):
                used.add(j)
                attempts += 1
                continue
            ok = c["type"] == "COMMAND_COMPLETED" and (c["exit_code"] == 0 or c["status"] == "ok")
            proof = {
                "test-failure": c["type"] == "TEST_PASSED", "build-failure": c["type"] == "BUILD_PASSED",
                "error": ok or c["type"] in ("TEST_PASSED", "BUILD_PASSED"),
            }.get(kind, ok and e["command"] is not None and c["command"] == e["command"])
            if proof:
                signal = c["id"]
                break
            if c["type"] == "SESSION_COMPLETED":
                signal = c["id"] if c["meta_outcome"] == "success" else None
                break
        out.append((e["id"], kind, attempts, signal))
    return out


def fails(e):
    t, st = e["type"], e["status"]
    if t in ("TEST_FAILED", "BUILD_FAILED"):
        return {"TEST_FAILED": "test-failure", "BUILD_FAILED": "build-failure"}[t]
    if t == "ERROR":
        return "error"
    if t == "COMMAND_COMPLETED" and ((e["exit_code"] or 0) != 0 or st in ("error", "timeout", "aborted")):
        return {"timeout": "timeout", "aborted": "abort"}.get(st, "command-failure")
    return None


def test_problems_equal_the_scan(spark):
    rnd = random.Random(7)
    rows, want = [], []
    for s in range(60):
        events = []
        for i in range(rnd.randrange(5, 40)):
            e = dict.fromkeys(FIELDS)
            e.update(id=f"s{s}e{i}", session_id=f"s{s}", agent_id="main", ts_ms=1000 + i // 2, input_index=i)
            e["type"] = rnd.choice(["TEST_FAILED", "TEST_PASSED", "BUILD_FAILED", "BUILD_PASSED", "ERROR", "COMMAND_COMPLETED", "COMMAND_COMPLETED", "FILE_CHANGED", "SESSION_COMPLETED"] if i % 9 == 8 else
                                   ["TEST_FAILED", "TEST_PASSED", "BUILD_FAILED", "BUILD_PASSED", "ERROR", "COMMAND_COMPLETED", "COMMAND_COMPLETED", "FILE_CHANGED"])
            if e["type"] == "COMMAND_COMPLETED":
                e["command"] = rnd.choice(["a", "b", None])
                e["exit_code"], e["status"] = rnd.choice([(0, "ok"), (1, "error"), (1, "ok"), (None, "timeout"), (None, "aborted")])
            if e["type"] == "ERROR":
                e["error"] = rnd.choice(["HTTP 429", "TypeError"])
            if e["type"] == "SESSION_COMPLETED":
                e["meta_outcome"] = rnd.choice(["success", "failure", None])
            events.append(e)
        rows += events
        want += scan(events)
    rnd.shuffle(rows)
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], SESSION_EVENT)
    found = Pr.detect_problems(df, S.agent_families(df), S.agent_graph(df))
    got = [(r.event_id, r.kind, r.attempts, r.signal_event_id) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def select_all(events):
    """Checkpoint selection over every event of one answer, one at a time."""
    picked, low, high, last, gain, fired, reads, total, prev = [], 0, 0, -999, 0, False, {}, 0, None
    for seq, kind, source, good in events:
        if good:
            gain, fired = seq, False
        t = ["CONTRADICTION"] * (kind == "CONTRADICTION") + ["NEW_BRANCH"] * (kind in ("SEARCH", "HYPOTHESIS"))
        if kind == "READ":
            total += 1
            reads[source] = reads.get(source, 0) + 1
            t += ["SOURCE_CONCENTRATION_THRESHOLD"] * (total >= 3 and reads[source] / total >= 0.6)
        stalled = not fired and gain > 0 and seq - gain >= 4
        t += ["NO_EVIDENCE_GAIN_WINDOW"] * stalled + ["PRE_RECOMMENDATION"] * (kind == "RECOMMEND" and prev is not None)
        at = prev if "PRE_RECOMMENDATION" in t else seq
        prev = seq
        urgent = "CONTRADICTION" in t or "PRE_RECOMMENDATION" in t
        if not t or low + high >= 10 or (not urgent and (low >= 8 or at - last < 3)):
            continue
        fired = fired or stalled
        picked.append((at, ",".join(t)))
        low, high, last = low + (not urgent), high + urgent, at
    return picked


def test_checkpoints_equal_the_scan(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for a in range(30):
        bias = rnd.choice([["VERIFY"] * 8, ["SEARCH"] * 3, ["READ"] * 5, ["CONTRADICTION"]])
        events = [(i + 1, rnd.choice(["SEARCH", "READ", "CLAIM", "VERIFY", "RECOMMEND", *bias]), rnd.choice("xyy"), rnd.random() < 0.15) for i in range(120)]
        want[f"a{a}"] = select_all(events)
        rows += [(f"a{a}", f"v{s}", s, k, src, "ADMISSIBLE" if g else "INADMISSIBLE") for s, k, src, g in events]
    evidence = spark.createDataFrame(rows, "aid string, event_id string, sequence bigint, type string, source string, admissibility string")
    got = {}
    for r in L.select_checkpoints(evidence, evidence).orderBy("aid", "ordinal").collect():
        got.setdefault(r.aid, []).append((r.anchor_seq, r.triggers))
    assert got == {k: v for k, v in want.items() if v}


QUICK = ("ses_problem_summary", "ses_files_x", "rep_verdict", "eva_policy", "ing_duplicates", "ans_resolve", "fn_normalize_location", "top_shared_source_edges")


@pytest.mark.parametrize("name", [q for q in QUICK if q != "ses_files_x"])
def test_query_equals_sql(spark, name):
    from tests.check_oracles import compare, oracle

    assert compare(spark, oracle(SF), name, SF).startswith("ok")
