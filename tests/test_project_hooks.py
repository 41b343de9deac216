"""Project hook packets: turns, lost calls, failures, every end state."""

import json

from tracelake.sources.project_hooks import hook_capture


def pre(i, url, **more):
    return {"hook_event_name": "PreToolUse", "tool_use_id": i, "tool_name": "WebFetch", "tool_input": {"url": url}, **more}


def post(i, url, **more):
    return {"hook_event_name": "PostToolUse", "tool_use_id": i, "tool_name": "WebFetch", "tool_input": {"url": url}, "tool_response": {"result": "Public read"}, **more}


START, END = {"hook_event_name": "SessionStart"}, {"hook_event_name": "SessionEnd"}
STOP = {"hook_event_name": "Stop", "last_assistant_message": "Same answer", "stop_hook_active": False}
A, B = "https://e.org/1", "https://e.org/2"
SESSIONS = {  # packets; gap codes, outcomes, sizes of receipts, last state
    "turns": ([START, pre("x", A), post("x", A), STOP, pre("x", B), post("x", B), STOP, END], [], ["SUCCESS", "SUCCESS"], [2, 2], "COMPLETED"),
    "failed": ([START, {"hook_event_name": "StopFailure"}, STOP, END], ["BOUNDARY", "FAILED"], [], [], "FAILED"),
    "lost": ([START, post("x", A), post("x", B), STOP, END], [], ["SUCCESS"], [2], "COMPLETED"),
    "cancelled": ([pre("x", A), END], ["BOUNDARY"], [], [], "CANCELLED"),
    "missing": ([START, pre("x", A), STOP, END], ["MISSING_RESULT"], [], [1], "COMPLETED"),
    "broken": ([START, pre("x", A), {**post("x", A), "hook_event_name": "PostToolUseFailure", "tool_response": None}, STOP, STOP, END], [], ["FAILED"], [2, 1], "COMPLETED"),
    "odd": ([START, pre(None, A), pre("b", A, tool_name="Bash"), pre("n", A, agent_id="sub"), {**post("x", A), "tool_response": None}, STOP, END], ["DRIFT", "NESTED", "UNKNOWN_TOOL"], [], [1], "COMPLETED"),
    "again": ([START, {"hook_event_name": "StopFailure"}, post("x", A), STOP, END], ["FAILED"], ["SUCCESS"], [2], "COMPLETED"),
}


def test_sessions(spark):
    flat = [(name, p) for name, (packets, *_) in SESSIONS.items() for p in packets]
    rows = [(i, json.dumps({"session_id": name, **p})) for i, (name, p) in enumerate(flat)] + [(900, "[]"), (901, '{"session_id":"z","hook_event_name":"Other"}')]
    found = hook_capture(spark.createDataFrame(rows, "line_no bigint, raw string"))
    records, gaps, scope, runs = (f.collect() for f in (found.records.orderBy("at"), found.gaps, found.scope, found.runs))
    names = {}
    from tracelake.functions.hashing import native_id
    from pyspark.sql import functions as F

    for r in spark.createDataFrame([(n,) for n in SESSIONS], "s string").select("s", F.concat(F.lit("run-claude-hook-"), native_id("s")).alias("run")).collect():
        names[r.run] = r.s
    got = {}
    for run, name in names.items():
        receipts = [r.record_id for r in records if r.run_id == run and r.record_kind == "answer"]
        got[name] = (
            sorted(g.code.removeprefix("NATIVE_") for g in gaps if g.run_id == run), [r.outcome for r in records if r.run_id == run and r.type in ("READ", "SEARCH")],
            [sum(s.receipt_id == i for s in scope) for i in receipts], next(r.lifecycle for r in runs if r.run_id == run),
        )
    assert got == {name: tuple(want) for name, (_, *want) in SESSIONS.items()}
    assert len(runs) == len(SESSIONS)
