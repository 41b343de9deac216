"""Native agent streams on hand-made packets: every gap code, failed and missing results, turns and scopes."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.sources.native_streams import native_capture

INIT = {"type": "system", "subtype": "init", "session_id": "S", "claude_code_version": "2.1.121"}
END = {"type": "result", "subtype": "success", "is_error": False, "session_id": "S", "uuid": "U", "result": "Public answer"}
START, DONE = {"type": "turn.started"}, {"type": "turn.completed"}


def call(i, name, given):
    return {"type": "assistant", "message": {"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": i, "name": name, "input": given}]}}


def result(i, content, bad=False):
    return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": content, "is_error": bad}]}}


def item(kind="item.completed", **fields):
    return {"type": kind, "item": fields}


def said(i, text="Same answer"):
    return item(id=i, type="agent_message", text=text)


def search(url):
    return item(id="s", type="web_search", action={"type": "search", "query": "q"}, results=[{"url": url}])


RUNS = {
    "ordered": ("claude-code", [INIT, result("two", "Request failed", True), call("one", "WebFetch", {"url": "https://e.org/1"}), call("two", "WebFetch", {"url": "https://e.org/2"}), result("one", "Read"), END]),
    "missing": ("claude-code", [INIT, call("r", "Read", {"file_path": "p.txt"}), END]),
    "strange": ("claude-code", [{**INIT, "claude_code_version": "9"}, call("u", "VerifyAll", {"query": "q"}), {**call("n", "WebSearch", {"query": "q"}), "parent_tool_use_id": "p"}, {**END, "is_error": True}]),
    "orphan": ("claude-code", [result("absent", "x"), {**END, "session_id": None}]),
    "late": ("claude-code", [INIT, END, call("late", "Read", {"file_path": "p"}), result("late", "x")]),
    "links": ("claude-code", [INIT, call("w", "WebSearch", {"query": "q"}), result("w", 'Found.\nLinks: [{"title":"T","url":"https://a.org/"},{"url":"ftp://no"}]'), END]),
    "clash": ("claude-code", [INIT, call("c", "Read", {"file_path": "a"}), call("c", "Read", {"file_path": "b"}), result("c", "x"), END]),
    "other": ("claude-code", [INIT, {**call("c", "Read", {"file_path": "a"}), "session_id": "T"}, END]),
    "secret": ("claude-code", [INIT, call("c", "Read", {"file_path": "a"}), result("c", [{"type": "thinking", "text": "private"}, {"type": "text", "text": "api_key=ABCDEFGH1234 public"}]), END]),
    "open": ("codex", [{"type": "thread.started", "thread_id": "T"}, START, said("m")]),
    "twice": ("codex", [{"type": "thread.started", "thread_id": "T"}, START, said("m"), DONE, START, said("m"), DONE]),
    "two": ("codex", [START, search("https://e.org/1"), search("https://e.org/2"), said("m"), DONE]),
    "failed": ("codex", [START, said("m"), {"type": "turn.failed"}, DONE]),
    "pending": ("codex", [START, item("item.started", id="s", type="web_search"), said("m"), DONE]),
    "noresult": ("codex", [START, item(id="s", type="web_search", action={"type": "open_page", "url": "https://e.org/"}), said("m"), DONE]),
    "unclean": ("codex", ["[]", {"no": "type"}, START, {"type": "news"}, item(id="f", type="file_change"), item(type="web_search"), said("m"), DONE]),
    "resumed": ("claude-code", [INIT, call("c", "Read", {"file_path": "a"}), {**INIT, "session_id": "T"}, {**END, "session_id": "T"}]),
}
EXPECTED = {  # gap codes, READ and SEARCH outcomes in order, receipts (scope declared, events), last state
    "ordered": ([], ["FAILED", "SUCCESS"], [(True, 3)], "COMPLETED"),
    "missing": (["MISSING_RESULT"], ["UNKNOWN"], [(True, 2)], "COMPLETED"),
    "strange": (["DRIFT", "FAILED", "NESTED", "UNKNOWN_TOOL"], [], [], "FAILED"),
    "orphan": (["ORPHAN_RESULT"], [], [(False, 0)], "COMPLETED"),
    "late": (["BOUNDARY"], [], [(True, 1)], "COMPLETED"),
    "links": ([], ["SUCCESS"], [(True, 2)], "COMPLETED"),
    "clash": (["BOUNDARY"], ["SUCCESS"], [(True, 2)], "COMPLETED"),
    "other": (["BOUNDARY"], [], [(True, 1)], "COMPLETED"),
    "secret": ([], ["SUCCESS"], [(True, 2)], "COMPLETED"),
    "open": (["BOUNDARY"], [], [], "UNKNOWN"),
    "twice": ([], [], [(True, 1), (True, 1)], "COMPLETED"),
    "two": (["BOUNDARY"], ["SUCCESS"], [(True, 2)], "COMPLETED"),
    "failed": (["BOUNDARY", "FAILED"], [], [], "FAILED"),
    "pending": (["MISSING_RESULT"], [], [(True, 1)], "COMPLETED"),
    "noresult": (["MISSING_RESULT"], ["UNKNOWN"], [(True, 2)], "COMPLETED"),
    "unclean": (["DRIFT", "MALFORMED", "UNKNOWN_TOOL"], [], [(True, 1)], "COMPLETED"),
    "resumed": (["BOUNDARY", "MISSING_RESULT"], ["UNKNOWN"], [(True, 1)], "COMPLETED"),
}


@pytest.fixture(scope="module")
def capture(spark):
    rows = [(run, a, "0.160.1" if a == "codex" else None, i, p if isinstance(p, str) else json.dumps(p)) for run, (a, packets) in RUNS.items() for i, p in enumerate(packets)]
    return native_capture(spark.createDataFrame(rows, "run_id string, adapter string, agent_version string, line_no bigint, raw string"))


def test_every_case(capture):
    gaps, records, scope = capture.gaps.collect(), capture.records.orderBy("run_id", "turn", "at").collect(), capture.scope.groupBy("receipt_id").count().collect()
    size, states = {r.receipt_id: r["count"] for r in scope}, {r.run_id: r.lifecycle for r in capture.runs.collect()}
    got = {
        run: (
            sorted(g.code.removeprefix("NATIVE_") for g in gaps if g.run_id == run), [r.outcome for r in records if r.run_id == run and r.type in ("READ", "SEARCH")],
            [(r.scope_declared, size.get(r.record_id, 0)) for r in records if r.run_id == run and r.record_kind == "answer"], states[run],
        )
        for run in RUNS
    }
    assert got == EXPECTED
    assert {c for codes, *_ in EXPECTED.values() for c in codes} == {"BOUNDARY", "DRIFT", "FAILED", "MALFORMED", "MISSING_RESULT", "NESTED", "ORPHAN_RESULT", "UNKNOWN_TOOL"}


def test_contents(capture):
    links = capture.records.where("run_id = 'links' AND type = 'SEARCH'").first()
    assert [(r.url, r.title, r["rank"]) for r in links.results] == [("https://a.org/", "T", 1)] and links.query == "q"
    text = str(capture.records.where("run_id = 'secret'").collect())
    assert "private" not in text and "ABCDEFGH1234" not in text and "public" in text
    twice = capture.records.where("run_id = 'twice' AND record_kind = 'answer'").collect()
    assert len({r.record_id for r in twice}) == 2 and len({r.answer_hash for r in twice}) == 1


def test_empty(spark):
    frame = spark.createDataFrame([], "run_id string, adapter string, agent_version string, line_no bigint, raw string")
    found = native_capture(frame)
    assert [f.where(F.lit(True)).count() for f in (found.records, found.scope, found.gaps, found.runs)] == [0, 0, 0, 0]
