"""Rollout logs on hand-made lines: pairing, nested programs, commands that never ran, turns and counters."""

import json

from tracelake.functions.hashing import change_fingerprint
from tracelake.sources import rollout_logs as P

T = "2026-01-01T00:00:%02dZ"


def lines(spark, rows, file="f"):
    body = [(file, i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(body, "file string, line_no bigint, raw string")


def item(i, **payload):
    return {"type": "response_item", "timestamp": T % i, "payload": payload}


def patch(*paths):
    return "*** Begin Patch\n" + "\n".join(f"*** Update File: {p}\n+x" for p in paths) + "\n*** End Patch"


def test_events(spark):
    program = "const p = `*** Begin Patch\n*** Add File: src/b.test.ts\\n\n+y\n*** End Patch`;\nawait tools.exec_command(\"cargo test\")"
    rows = [
        "not json", {"type": "response_item", "payload": None},
        {"type": "session_meta", "timestamp": T % 1, "payload": {"id": "abcdefgh-1", "cwd": "/w"}},
        item(2, type="custom_tool_call", name="apply_patch", call_id="p0", input=patch("a.ts")),
        {"type": "turn_context", "timestamp": T % 3, "payload": {}},
        item(4, type="custom_tool_call", name="apply_patch", call_id="p1", input=patch("a.ts", "a.ts", "b.ts")),
        item(5, type="function_call", name="shell_command", call_id="c1", arguments=json.dumps({"command": ["npm", "test"]})),
        item(6, type="function_call_output", call_id="c1", output=[{"type": "x", "text": "Exit code: 1"}, {"text": "3 tests failed"}]),
        item(7, type="function_call_output", call_id="c1", output="exit code: 0"),
        item(8, type="custom_tool_call", name="exec", call_id="x1", input=program),
        item(9, type="custom_tool_call_output", call_id="x1", output="exit code: 0"),
        item(10, type="function_call", name="shell_command", call_id="c2", arguments=json.dumps({"command": "adb devices"})),
        item(11, type="function_call_output", call_id="c2", output="windows sandbox: could not launch"),
        item(12, type="function_call", name="shell_command", call_id="c3", arguments="{"),
        item(13, type="function_call", name="Edit", id="e1", arguments=json.dumps({"patch": patch("c.ts")})),
        item(14, type="function_call", name="other_tool", call_id="o", arguments="{}"),
        {"type": "token_usage_record", "timestamp": T % 15, "payload": {"thread_token_usage": {"total_tokens": 70}}},
        {"type": "token_usage_record", "timestamp": T % 16, "payload": {"thread_token_usage": {"total_tokens": "70"}}},
    ]
    events, tokens, facts = P.codex_replay(lines(spark, rows), "key")
    got = [
        (r.seq, r.event_type, r.ts_offset, r.tool_name, r.ok, r.verification_kind, r.changed_files, r.fingerprint_basis, r.tests_failed, r.turn, r.test_only, r.path)
        for r in events.orderBy("seq").collect()
    ]
    assert got == [
        (1, "implementation", 0, "apply_patch", None, None, 1, "content", None, None, False, "a.ts"),
        (2, "implementation", 2_000, "apply_patch", None, None, 2, "content", None, 1, False, "a.ts"),
        (3, "verification", 3_000, "shell_command", False, "test", None, None, 3, None, None, None),
        (4, "implementation", 6_000, "apply_patch", None, None, 1, "content", None, 1, True, "src/b.test.ts"),
        (5, "verification", 6_000, "exec", True, "test", None, None, 0, None, None, None),
        (6, "other", 8_000, "shell_command", None, None, None, None, None, None, None, None),
        (7, "other", 10_000, "shell_command", None, None, None, None, None, None, None, None),
        (8, "implementation", 11_000, "apply_patch", None, None, 1, "content", None, 1, False, "c.ts"),
    ]
    assert [(r.record_no, r.total_tokens) for r in tokens.collect()] == [(17, 70)]
    [row] = facts.collect()
    assert (row.session_id, row.turn_aware, row.mobile, row.last_ms - row.epoch_ms) == ("abcdefgh", True, True, 14_000)
    from pyspark.sql import functions as F

    [want] = spark.range(1).select(change_fingerprint(F.lit("patch"), F.array(F.lit(patch("a.ts"))), "key")).first()
    assert events.where("seq = 1").first().change_hash == want
    assert {r.change_hash for r in P.codex_replay(lines(spark, rows))[0].collect()} == {None}


def test_a_repeated_id_answers_the_nearest_call(spark):
    call = dict(type="function_call", name="shell_command", call_id="c", arguments=json.dumps({"command": "npm test"}))
    rows = [item(1, **call), item(2, **call), item(3, type="function_call_output", call_id="c", output="exit code: 0"), item(4, type="function_call_output", call_id="c", output="exit code: 1")]
    assert [r.ok for r in P.codex_replay(lines(spark, rows))[0].orderBy("seq").collect()] == [None, True]


def test_empty(spark):
    assert [f.count() for f in P.codex_replay(lines(spark, []))] == [0, 0, 0]
