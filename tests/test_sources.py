"""Sources on small hand-made logs."""

import json

from pyspark.sql import functions as F

from tracelake.sources import device, lines as L, session_logs as S


def numbered(spark, rows, file="f1"):
    body = [(file, i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(body, "file string, line_no bigint, raw string")


def test_loss_honest_scan(spark, tmp_path):
    data = b'{"a": 1}\r\n\nnot json\n{"b": "\xff"}\n  \n{"c": '
    (tmp_path / "x.jsonl").write_bytes(data)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    assert L.discover(spark, [str(tmp_path)]).count() == 1
    rows = L.read_lines(spark, str(tmp_path))
    good, losses, blank = L.scan_losses(rows)
    assert [(r.line_no, r.byte_offset) for r in good.collect()] == [(1, 0)]
    got = {(r.line_no, r.code, r.byte_offset, r.definitive) for r in losses.collect()}
    assert got == {(3, "MALFORMED_JSON", 11, True), (4, "INVALID_UTF8", 20, True), (6, "TRUNCATED_TAIL", data.rindex(b"{"), False)}
    assert sorted(r.line_no for r in blank.collect()) == [2, 5]


def test_tolerant_scan_and_generic_events(spark):
    rows = numbered(spark, [
        {"id": "e1", "sessionId": "s", "type": "MESSAGE", "timestamp": "2026-01-01T00:00:00Z", "summary": "hi", "metadata": {"role": "user"}},
        "broken {",
        {"id": "e2", "sessionId": "s", "type": "NOPE", "timestamp": "2026-01-01T00:00:00Z"},
    ])
    ok, warnings = L.scan_tolerant(rows)
    assert ok.count() == 2 and [r.warning for r in warnings.collect()] == ["line 2: invalid JSON skipped"]
    good, bad = S.generic_events(rows)
    assert [(r.id, r.meta_role, r.source) for r in good.collect()] == [("e1", "user", "generic-jsonl")]
    assert {r.line_no for r in bad.collect()} == {2, 3}


def test_detect_adapter(spark):
    frames = [
        numbered(spark, [{"type": "session_meta", "payload": {}}], "codex"),
        numbered(spark, [{"type": "user", "sessionId": "s", "parentUuid": None}], "claude"),
        numbered(spark, [{"sessionId": "s", "response": {"toolCalls": []}}], "zcode"),
        numbered(spark, [{"id": "1", "type": "MESSAGE", "sessionId": "s", "timestamp": "t"}], "generic"),
        numbered(spark, ["hello"], "none"),
    ]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.union(f)
    got = {r.file: r.adapter for r in L.detect_adapter(rows).collect()}
    assert got == {"codex": "codex", "claude": "claude", "zcode": "zcode", "generic": "generic-jsonl", "none": None}


def test_rollout_log(spark):
    t = "2026-01-01T00:00:0%dZ"
    item = lambda i, **p: {"type": "response_item", "timestamp": t % i, "payload": p}
    rows = numbered(spark, [
        {"type": "session_meta", "timestamp": t % 0, "payload": {"id": "abc", "cwd": "/home/me/proj"}},
        item(1, type="message", role="user", content=[{"type": "input_text", "text": "fix it"}]),
        item(2, type="custom_tool_call", name="apply_patch", call_id="c1", input="*** Begin Patch\n*** Update File: /home/me/proj/src/a.ts\n*** Add File: b.ts\n*** End Patch"),
        item(3, type="custom_tool_call_output", call_id="c1", output="done"),
        item(4, type="function_call", name="shell", call_id="c2", arguments=json.dumps({"command": ["npm", "test"]})),
        item(5, type="function_call_output", call_id="c2", output="3 tests failed\nexit code: 1"),
        item(6, type="function_call", name="web", call_id="c3", arguments="{}"),
        item(7, type="function_call_output", call_id="c3", output="ok"),
    ])
    got = S.codex_events(rows).orderBy("input_index").collect()
    assert [r.type for r in got] == ["SESSION_STARTED", "MESSAGE", "FILE_CREATED", "FILE_CHANGED", "TEST_STARTED", "TEST_FAILED", "TOOL_CALLED", "TOOL_RESULT"]
    assert {r.session_id for r in got} == {"abc"} and got[3].file_path == "src/a.ts" and got[3].status == "ok"
    assert got[5].parent_id == got[4].id == "cx00005" and got[5].exit_code == 1 and got[5].meta_tests_failed == 3 and got[5].command == "npm test"


def test_chat_log(spark):
    t = "2026-01-01T00:00:0%dZ"
    use = lambda i, **b: {"type": "assistant", "timestamp": t % i, "sessionId": "s1", "cwd": "/w/p", "message": {"content": [{"type": "tool_use", **b}]}}
    res = lambda i, call, bad, text: {"type": "user", "timestamp": t % i, "message": {"content": [{"type": "tool_result", "tool_use_id": call, "is_error": bad, "content": text}]}}
    rows = numbered(spark, [
        {"type": "user", "timestamp": t % 0, "sessionId": "s1", "cwd": "/w/p", "message": {"content": "please fix"}},
        {"type": "assistant", "timestamp": t % 1, "message": {"content": [{"type": "text", "text": "on it"}, {"type": "text", "text": "on it"}]}},
        use(2, id="u1", name="Edit", input={"file_path": "/w/p/src/a.py"}),
        use(3, id="u2", name="Bash", input={"command": "pytest -q"}),
        res(4, "u2", True, "2 tests failed"),
        {**use(5, id="u3", name="Read", input={"file_path": "/w/p/b.py"}), "isSidechain": True},
        use(6, id="longid-12345678", name="Task", input={"description": "look around"}),
        {"type": "assistant", "timestamp": t % 7, "isApiErrorMessage": True, "message": {"content": [{"type": "text", "text": "API Error: 529"}]}},
        res(8, "u1", True, "no such file"),
    ])
    got = S.claude_events(rows).orderBy("input_index").collect()
    assert [r.type for r in got] == [
        "SESSION_STARTED", "MESSAGE", "MESSAGE", "FILE_CHANGED", "TEST_STARTED", "TEST_FAILED", "SUBAGENT_STARTED", "FILE_READ", "SUBAGENT_STARTED", "ERROR", "MESSAGE", "TOOL_RESULT",
    ]
    by = {r.id: r for r in got}
    assert got[3].file_path == "src/a.py" and got[5].parent_id == got[4].id and got[5].meta_tests_failed == 2
    assert got[8].agent_id == "sub-12345678" and got[8].meta_task == "look around" and got[9].error == "API Error: 529"
    assert by[got[11].parent_id].type == "FILE_CHANGED"


def test_hooks_and_device(spark):
    rows = numbered(spark, [
        {"ts": "2026-01-01T00:00:00Z", "sessionId": "s", "toolName": "Edit", "ok": True, "changeFingerprint": "h1", "fingerprintBasis": "content", "turn": 1},
        {"ts": "2026-01-01T00:00:02Z", "sessionId": "s", "toolName": "Bash", "ok": None, "verificationKind": "test", "testsFailedCount": 0},
        {"ts": "2026-01-01T00:00:03Z", "sessionId": "s", "toolName": "Bash", "verificationKind": "other"},
    ])
    got = S.hook_replay_events(rows).orderBy("seq").collect()
    assert [(r.event_type, r.ts_offset, r.ok, r.change_hash) for r in got] == [("implementation", 0, True, "h1"), ("verification", 2000, True, None)]
    snap = "Page: Login\n@e1 [button] Sign in [enabled]\n@e2~s1 [text] Hello\n"
    moved = "Page: Login\n@e9 [text] Hello\n@e3 [button] Sign in [focused] [enabled]\n"
    logs = "x\njava.lang.NullPointerException: boom\n at android.os.Handler.run(Handler.java)\n at com.app.ui.LoginModel.onSubmit(LoginModel.kt:4)\n"
    df = spark.createDataFrame([("a", snap, logs), ("b", moved, "kotlin.SomeError: x\n at java.lang.A.b(C)"), ("c", None, "quiet")], "attempt_id string, snapshot_text string, logs_text string")
    by = {r.attempt_id: r for r in device.capture_evidence(df).collect()}
    assert by["a"].screen_sig == by["b"].screen_sig and by["a"].screen_sig.startswith("Login#")
    assert by["a"].crash_sig == "NullPointerException:LoginModel#onSubmit" and by["b"].crash_sig == "SomeError" and by["c"].crash_sig is None
    assert [by[x].verified for x in "abc"] == [True, True, False]


def test_series_file(spark, tmp_path):
    row = {"attemptId": "a1", "build": {"status": "pass"}, "tests": {"failedCount": 2}, "runtime": {"crashSignature": None, "screenSignature": "S"}, "verification": {"performed": True}, "code": {"changedFilesCount": 1, "changeSetHash": "h"}}
    (tmp_path / "one.json").write_text(json.dumps([row, {**row, "attemptId": "a2"}]))
    (tmp_path / "two.json").write_text(json.dumps({"contract": {}, "attempts": [row]}))
    got = device.attempt_series(spark, str(tmp_path)).groupBy("series_id").agg(F.max("idx").alias("n"), F.min("tests_failed").alias("t")).collect()
    assert {(r.series_id, r.n, r.t) for r in got} == {("one.json", 1, 2), ("two.json", 0, 2)}
