"""Agent session logs as session events (``tracelake.schemas.SESSION_EVENT``).

Input: numbered lines (file, line_no, raw). Calls meet their results by an equi-join on (file, call id);
what holds "from here on" in a file (session id, working folder) is an ordered scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.commands import classify_verification, display_path, exit_code, extract_failed_count, patch_files
from ..functions.text import ellipsis, first_line
from ..operators.ordered import last_seen, ordered_scan, running_sum
from ..operators.validate import validate_session_events
from ..schemas import SESSION_EVENT

# Tool names per role.
SHELL_TOOLS = ("shell", "exec", "local_shell", "container.exec", "exec_command")
WRITE_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
READ_TOOLS = ("Read", "View", "Open")
_COLUMNS = [c.strip().split(" ") for c in SESSION_EVENT.split(",")]


def _chunk() -> Column:
    return F.floor(F.col("line_no") / 65_536)


def _events(parts: list[DataFrame], prefix: str, source: str) -> DataFrame:
    """Union of event rows (file, line_no, sub, …) with ids and input order per file."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    numbered = ordered_scan(rows, ["file"], ["line_no", "sub"], _chunk(), input_index=running_sum(F.lit(1)))
    have = set(numbered.columns)
    fixed = {"id": F.concat(F.lit(prefix), F.lpad(F.col("input_index").cast("string"), 5, "0")), "source": F.lit(source)}
    cols = [(fixed.get(n) if n in fixed else F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in _COLUMNS]
    return numbered.select("file", "line_no", "sub", *([F.col("call")] if "call" in have else []), *cols)


def _millis(c: Column) -> Column:
    return F.unix_millis(c.try_cast("timestamp"))


def _text_of(c: Column) -> Column:
    """Text of a string, or of a list of ``{text}`` parts, one per line."""
    parts = F.from_json(c, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return F.coalesce(F.when(F.startswith(c, F.lit("[")), joined), c, F.lit(""))


def generic_events(lines: DataFrame, label: str = "generic-jsonl") -> tuple[DataFrame, DataFrame]:
    """Lines that already are session events, and the refused ones with their first error."""
    good, bad = validate_session_events(lines.where(F.trim("raw") != "").withColumn("raw", F.trim("raw")))
    body = F.from_json("raw", (
        "id string, sessionId string, parentId string, agentId string, parentAgentId string, type string, timestamp string, durationMs double, source string, "
        "summary string, filePath string, command string, toolName string, status string, error string, exitCode int, "
        "metadata struct<role:string,task:string,cwd:string,outcome:string,status:string,testsFailedCount:double,additions:double,deletions:double>"
    ))
    e = good.select("file", "line_no", body.alias("e"))
    names = {
        "session_id": "sessionId", "parent_id": "parentId", "agent_id": "agentId", "parent_agent_id": "parentAgentId", "duration_ms": "durationMs",
        "file_path": "filePath", "tool_name": "toolName", "exit_code": "exitCode", "meta_role": "metadata.role", "meta_task": "metadata.task", "meta_cwd": "metadata.cwd",
        "meta_outcome": "metadata.outcome", "meta_status": "metadata.status", "meta_tests_failed": "metadata.testsFailedCount", "meta_additions": "metadata.additions", "meta_deletions": "metadata.deletions",
    }
    cols = []
    for n, t in _COLUMNS:
        if n == "ts_ms":
            c = F.coalesce(_millis(F.col("e.timestamp")), F.lit(0))
        elif n == "input_index":
            c = F.col("line_no")
        elif n == "source":
            c = F.coalesce("e.source", F.lit(label))
        else:
            c = F.col(f"e.{names.get(n, n)}")
        cols.append(c.cast(t).alias(n))
    return e.select("file", *cols), bad.select("file", "line_no", F.get("errors", 0).alias("error"))


def codex_events(lines: DataFrame) -> DataFrame:
    """Rollout log: messages, patches as file events, shell calls as commands, tests or builds, other calls as tools."""
    shape = (
        "timestamp string, type string, payload struct<type:string,id:string,session_id:string,cwd:string,role:string,name:string,input:string,"
        "arguments:string,call_id:string,content:string,output:string>"
    )
    rows = lines.withColumn("j", F.from_json("raw", shape)).select("file", "line_no", "j.type", _millis(F.col("j.timestamp")).alias("ts_ms"), F.col("j.payload").alias("p")).where(
        "ts_ms is not null and type in ('session_meta', 'response_item')"
    )
    meta = F.col("type") == "session_meta"
    folder = meta & F.col("p.cwd").isNotNull()
    seen = ordered_scan(
        rows, ["file"], ["line_no"], _chunk(),
        _sid=last_seen(F.coalesce("p.session_id", "p.id"), meta, inclusive=True), meta_folder=last_seen(F.col("p.cwd"), folder, inclusive=True),
    ).withColumn("session_id", F.coalesce("_sid", F.lit("codex-session"))).withColumn("agent_id", F.lit("main")).drop("_sid")
    base = ["file", "line_no", "session_id", "agent_id", "ts_ms"]
    zero = F.lit(0).alias("sub")
    starts = seen.where(meta).select(
        *base, zero, F.lit("SESSION_STARTED").alias("type"), F.coalesce(F.concat(F.lit("Session started in "), "meta_folder"), F.lit("Session started")).alias("summary"), F.col("meta_folder").alias("meta_cwd")
    )
    said = seen.where((F.col("p.type") == "message") & ~meta).withColumn("_t", _text_of(F.col("p.content"))).where("_t <> ''").select(
        *base, zero, F.lit("MESSAGE").alias("type"), first_line(F.col("_t")).alias("summary"), F.coalesce("p.role", F.lit("assistant")).alias("meta_role")
    )
    raw_input = F.coalesce("p.input", "p.arguments", F.lit(""))
    calls = seen.where(F.col("p.type").isin("custom_tool_call", "function_call")).select(*base, "meta_folder", F.coalesce("p.name", F.lit("unknown")).alias("tool_name"), raw_input.alias("_in"), F.col("p.call_id").alias("call"), "p.input", "p.arguments")
    is_patch = (F.col("tool_name") == "apply_patch") | F.contains("_in", F.lit("*** Begin Patch"))
    outputs = seen.where(F.col("p.type").isin("custom_tool_call_output", "function_call_output")).select("file", F.col("line_no").alias("out_line"), F.col("ts_ms").alias("out_ms"), F.col("p.call_id").alias("call"), _text_of(F.col("p.output")).alias("_out"))
    # A call takes its first result; later ones with the same id have nothing to answer.
    first = outputs.join(calls.select("file", "call", F.col("line_no").alias("_at")), ["file", "call"]).where("out_line > _at").groupBy("file", "call").agg(F.min_by(F.struct("out_line", "out_ms", "_out"), "out_line").alias("r"))
    paired = calls.join(first, ["file", "call"], "left").withColumn("code", exit_code(F.col("r._out"))).withColumn("failed", F.coalesce(F.col("code") != 0, F.lit(False)))
    unescaped = F.when(
        F.contains("_in", F.lit("*** Begin Patch")), F.regexp_replace(F.regexp_replace(F.regexp_replace("_in", r"\\\\", r"\\"), r"\\n", "\n"), r"\\r", "")
    ).otherwise(F.col("_in"))
    ranked = F.array_sort(F.transform(patch_files(unescaped), lambda f, i: F.struct(F.when(f["op"] == "add", 0).when(f["op"] == "update", 1).otherwise(2).alias("r"), i.alias("i"), f["op"].alias("op"), f["path"].alias("path"))))
    files = paired.where(is_patch).select("*", F.posexplode(ranked).alias("sub", "f")).withColumn("file_path", display_path(F.col("f.path"), F.col("meta_folder")))
    op = F.col("f.op")
    patched = files.select(
        *base, "sub", F.when(op == "add", "FILE_CREATED").when(op == "delete", "FILE_DELETED").otherwise("FILE_CHANGED").alias("type"), F.lit("apply_patch").alias("tool_name"), "file_path",
        F.when(F.col("r").isNotNull() & ~F.col("failed"), "ok").otherwise("running").alias("status"),
        F.concat(F.when(op == "add", "Created ").when(op == "delete", "Deleted ").otherwise("Modified "), "file_path").alias("summary"),
    )
    done = ["file", F.col("r.out_line").alias("line_no"), "session_id", "agent_id", F.col("r.out_ms").alias("ts_ms")]
    broken = files.where("failed and sub = 0").select(
        *done, zero, F.lit("COMMAND_COMPLETED").alias("type"), F.lit("apply_patch").alias("tool_name"), F.lit("apply_patch").alias("command"), F.col("code").alias("exit_code"),
        F.lit("error").alias("status"), first_line(F.col("r._out"), 200).alias("error"), F.lit("apply_patch failed").alias("summary"),
    )
    arg = F.get_json_object("arguments", "$.command")
    listed = F.array_join(F.from_json(arg, "array<string>"), " ")
    quoted = r'exec_command\(\s*(?:\{\s*cmd:\s*)?"((?:[^"\\]|\\.)*)"'
    inner = F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_extract("input", quoted, 1), r'\\"', '"'), r"\\n", " "), F.lit(""))
    command = F.coalesce(F.when(F.startswith(arg, F.lit("[")), listed).otherwise(arg), inner, first_line(F.col("input"), 300))
    shell = paired.where(~is_patch & F.col("tool_name").isin(*SHELL_TOOLS)).withColumn("command", command).withColumn("kind", classify_verification(F.col("command")))
    kind, failed = F.col("kind"), F.col("failed")
    label = first_line(F.coalesce("command", F.lit("tests")), 80)
    shell_start = shell.select(
        *base, zero, F.when(kind == "test", "TEST_STARTED").when(kind == "build", "BUILD_STARTED").otherwise("COMMAND_STARTED").alias("type"), "tool_name", "command", F.lit("running").alias("status"),
        F.concat(F.lit("Ran "), F.coalesce(first_line(F.col("command"), 120), "tool_name")).alias("summary"), F.col("call"),
    )
    n = F.when((kind == "test") & failed, extract_failed_count(F.col("r._out")))
    shell_end = shell.where("r is not null").select(
        *done, zero,
        F.when(kind == "test", F.when(failed, "TEST_FAILED").otherwise("TEST_PASSED")).when(kind == "build", F.when(failed, "BUILD_FAILED").otherwise("BUILD_PASSED")).otherwise("COMMAND_COMPLETED").alias("type"),
        "tool_name", "command", F.col("code").alias("exit_code"), F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, first_line(F.col("r._out"), 200)).alias("error"),
        n.alias("meta_tests_failed"), F.concat(label, F.when(failed, " — failed").otherwise(" — passed")).alias("summary"), F.col("call").alias("answers"),
    )
    other = paired.where(~is_patch & ~F.col("tool_name").isin(*SHELL_TOOLS))
    tool_start = other.select(*base, zero, F.lit("TOOL_CALLED").alias("type"), "tool_name", F.lit("running").alias("status"), F.concat(F.lit("Called "), "tool_name").alias("summary"), F.col("call"))
    tool_end = other.where("r is not null").select(*done, zero, F.lit("TOOL_RESULT").alias("type"), "tool_name", F.lit("ok").alias("status"), F.concat("tool_name", F.lit(" result")).alias("summary"), F.col("call").alias("answers"))
    return _link(_events_raw([starts, said, patched, broken, shell_start, shell_end, tool_start, tool_end]), "cx", "codex")


def _events_raw(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows


def _link(rows: DataFrame, prefix: str, source: str) -> DataFrame:
    """Ids by position, and the id of the call as parent of its result."""
    numbered = ordered_scan(rows, ["file"], ["line_no", "sub"], _chunk(), input_index=running_sum(F.lit(1))).withColumn(
        "id", F.concat(F.lit(prefix), F.lpad(F.col("input_index").cast("string"), 5, "0"))
    )
    calls = numbered.where("call is not null").select("file", F.col("call").alias("answers"), F.col("id").alias("parent_id"))
    linked = numbered.join(calls, ["file", "answers"], "left")
    have = set(linked.columns)
    return linked.select("file", *[(F.lit(source) if n == "source" else F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in _COLUMNS])


def claude_events(lines: DataFrame) -> DataFrame:
    """Chat-style log: the first line opens the session, sidechain lines are one subagent, tool uses meet their results."""
    shape = (
        "type string, timestamp string, sessionId string, cwd string, isSidechain boolean, isMeta boolean, isApiErrorMessage boolean, error string, "
        "message struct<content:string>, toolUseResult struct<stderr:string,durationMs:double>"
    )
    j = lines.withColumn("j", F.from_json("raw", shape)).select("file", "line_no", "j.*").withColumn("ts_ms", _millis(F.col("timestamp")))
    seen = ordered_scan(j, ["file"], ["line_no"], _chunk(), folder=last_seen(F.col("cwd"), F.col("cwd") != "", inclusive=True))
    first_sid = j.where("sessionId is not null").groupBy("file").agg(F.min_by("sessionId", "line_no").alias("session_id"))
    rows = (
        seen.where("type in ('assistant', 'user') and ts_ms is not null").join(first_sid, "file", "left")
        .withColumn("session_id", F.coalesce("session_id", F.lit("claude-session")))
        .withColumn("agent_id", F.when(F.col("isSidechain"), "sidechain").otherwise("main")).withColumn("content", F.col("message.content"))
    )
    base = ["file", "line_no", "session_id", "agent_id", "ts_ms"]
    at = F.struct("line_no")
    opening = rows.groupBy("file").agg(F.min_by(F.struct("line_no", "session_id", "ts_ms", "folder"), "line_no").alias("f"), F.min_by(F.struct("line_no", "session_id", "ts_ms"), F.when(F.col("agent_id") == "sidechain", at)).alias("s"))
    started = opening.select(
        "file", "f.line_no", "f.session_id", "f.ts_ms", F.lit(-2).alias("sub"), F.lit("main").alias("agent_id"), F.lit("SESSION_STARTED").alias("type"),
        F.coalesce(F.concat(F.lit("Session started in "), "f.folder"), F.lit("Session started")).alias("summary"), F.col("f.folder").alias("meta_cwd"),
    )
    side = opening.where("s is not null").select(
        "file", "s.line_no", "s.session_id", "s.ts_ms", F.lit(-1).alias("sub"), F.lit("sidechain").alias("agent_id"), F.lit("main").alias("parent_agent_id"), F.lit("SUBAGENT_STARTED").alias("type"),
        F.lit("running").alias("status"), F.lit("Subagent (sidechain) activity started").alias("summary"),
    )
    is_list = F.startswith("content", F.lit("["))
    block = "array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,is_error:boolean,content:string,input:struct<file_path:string,command:string,description:string,prompt:string>>>"
    typed = rows.where((F.col("type") == "user") & ~F.coalesce("isMeta", F.lit(False)) & ~is_list).withColumn("summary", first_line(F.col("content"), strip_markup=True)).where("summary <> ''").select(
        *base, F.lit(0).alias("sub"), F.lit("MESSAGE").alias("type"), "summary", F.lit("user").alias("meta_role")
    )
    api = rows.where((F.col("type") == "assistant") & (F.coalesce("isApiErrorMessage", F.lit(False)) | F.col("error").isNotNull()))
    api_text = F.when(is_list, F.array_join(F.transform(F.from_json("content", block), lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).otherwise("")), "\n"))
    identity = first_line(F.coalesce(F.nullif(api_text, F.lit("")), "error", F.lit("API error")), 200, strip_markup=True)
    errors = api.withColumn("error", identity).where("error <> '' and lower(error) <> 'unknown'").select(
        *base, F.lit(0).alias("sub"), F.lit("ERROR").alias("type"), F.lit("error").alias("status"), "error", F.lit("API error reported").alias("summary")
    )
    blocks = rows.where(is_list & ~(F.coalesce("isMeta", F.lit(False)) & (F.col("type") == "user"))).select(
        *base, "folder", F.col("type").alias("speaker"), "toolUseResult", F.posexplode(F.from_json("content", block)).alias("sub", "b")
    ).withColumn("sub", F.col("sub") + 1)
    talk = blocks.where("speaker = 'assistant' and b.type = 'text'").withColumn("summary", first_line(F.coalesce("b.text", F.lit("")), strip_markup=True)).where("summary <> ''")
    # The same message repeated at the same time counts once, the first.
    once = talk.groupBy("file", "agent_id", "ts_ms", "summary").agg(F.min(F.struct("line_no", "sub")).alias("_first"), F.first("session_id").alias("session_id")).select(
        "file", "_first.line_no", "session_id", "agent_id", "ts_ms", "_first.sub", F.lit("MESSAGE").alias("type"), "summary", F.lit("assistant").alias("meta_role")
    )
    uses = blocks.where("speaker = 'assistant' and b.type = 'tool_use' and b.name is not null").select(
        *base, "sub", F.col("b.name").alias("tool_name"), F.col("b.id").alias("call"), F.when(F.col("b.input.file_path") != "", display_path(F.col("b.input.file_path"), F.col("folder"))).alias("file_path"),
        F.col("b.input.command").alias("command"), F.coalesce("b.input.description", "b.input.prompt").alias("_task"),
    )
    tool, path = F.col("tool_name"), F.col("file_path")
    role = (
        F.when(tool.isin(*WRITE_TOOLS) & path.isNotNull(), "file").when(tool.isin(*READ_TOOLS) & path.isNotNull(), "read").when((tool == "Bash") & F.col("command").isNotNull(), "command")
        .when(tool.isin("Task", "Agent"), "subagent").otherwise("tool")
    )
    uses = uses.withColumn("role", role).withColumn("kind", F.when(F.col("role") == "command", classify_verification(F.col("command")))).withColumn(
        "meta_task", F.when(F.col("role") == "subagent", F.nullif(first_line(F.coalesce("_task", F.lit("")), 120, strip_markup=True), F.lit("")))
    )
    r, kind = F.col("role"), F.col("kind")
    used = uses.select(
        "file", "line_no", "session_id", "ts_ms", "sub", "tool_name", "file_path", F.when(r == "command", F.col("command")).alias("command"), "meta_task",
        F.when(r == "subagent", F.concat(F.lit("sub-"), F.right("call", F.lit(8)))).otherwise(F.col("agent_id")).alias("agent_id"), F.when(r == "subagent", F.col("agent_id")).alias("parent_agent_id"),
        F.when(r == "file", F.when(tool.isin("Write", "NotebookEdit"), "FILE_CREATED").otherwise("FILE_CHANGED")).when(r == "read", "FILE_READ")
        .when(r == "command", F.when(kind == "test", "TEST_STARTED").when(kind == "build", "BUILD_STARTED").otherwise("COMMAND_STARTED")).when(r == "subagent", "SUBAGENT_STARTED").otherwise("TOOL_CALLED").alias("type"),
        F.when(r == "read", "ok").otherwise("running").alias("status"), F.when(r != "read", F.col("call")).alias("call"),
        F.when(r == "command", F.concat(F.lit("Ran "), "command")).when(r == "subagent", F.coalesce(F.concat(F.lit("Subagent started: "), "meta_task"), F.lit("Subagent started")))
        .when(r == "read", F.concat(F.lit("Read "), "file_path")).when(r == "file", F.concat(F.when(tool.isin("Write", "NotebookEdit"), "Created ").otherwise("Modified "), "file_path"))
        .otherwise(F.coalesce(F.concat_ws(" ", F.when(path.isNotNull(), tool), path), F.concat(F.lit("Called "), tool))).alias("summary"),
    )
    results = blocks.where("speaker = 'user' and b.type = 'tool_result'").select(
        "file", F.col("b.tool_use_id").alias("call"), "line_no", "ts_ms", "sub", F.coalesce("b.is_error", F.lit(False)).alias("bad"), F.col("toolUseResult.durationMs").alias("duration_ms"),
        F.regexp_replace(F.concat(F.coalesce("toolUseResult.stderr", F.lit("")), F.lit("\n"), _text_of(F.col("b.content"))), r"^\s+|\s+$", "").alias("_out"),
    )
    won = results.groupBy("file", "call").agg(F.min_by(F.struct("line_no", "ts_ms", "sub", "bad", "duration_ms", "_out"), F.struct("line_no", "sub")).alias("o"))
    answered = uses.where("role <> 'read'").select("file", "session_id", "agent_id", "call", "tool_name", "role", "kind", F.when(r == "command", F.col("command")).alias("command"), "file_path").join(won, ["file", "call"]).where("role = 'command' or o.bad")
    bad = F.col("o.bad")
    ended = answered.select(
        "file", "session_id", "agent_id", "o.line_no", "o.ts_ms", "o.sub", "tool_name", "command", F.when(F.col("role") != "command", F.col("file_path")).alias("file_path"), F.when(F.col("role") == "command", F.col("o.duration_ms")).alias("duration_ms"),
        F.when(F.col("role") != "command", "TOOL_RESULT").when(kind == "test", F.when(bad, "TEST_FAILED").otherwise("TEST_PASSED")).when(kind == "build", F.when(bad, "BUILD_FAILED").otherwise("BUILD_PASSED")).otherwise("COMMAND_COMPLETED").alias("type"),
        F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, first_line(F.col("o._out"), 200, strip_markup=True)).alias("error"),
        F.when(kind == "test", extract_failed_count(F.col("o._out"))).alias("meta_tests_failed"), F.col("call").alias("answers"),
        F.when(F.col("role") != "command", F.concat("tool_name", F.lit(" reported an error"))).otherwise(F.concat(F.coalesce("command", "tool_name"), F.when(kind.isNull(), " finished").when(bad, " — failed").otherwise(" — passed"))).alias("summary"),
    )
    return _link(_events_raw([started, side, typed, errors, once, used, ended]), "cl", "claude")


def hook_replay_events(lines: DataFrame) -> DataFrame:
    """Hook log as replay events; an unknown outcome of a verification falls back to its failure count."""
    shape = "ts string, sessionId string, toolName string, ok boolean, fileHash string, changeFingerprint string, fingerprintBasis string, verificationKind string, testsFailedCount int, turn bigint, testOnly boolean"
    e = lines.withColumn("e", F.from_json("raw", shape)).where("e.toolName is not null").select("file", "line_no", "e.*").withColumn("_ms", _millis(F.col("ts")))
    epoch = e.groupBy("file").agg(F.min("_ms").alias("_epoch"))
    impl = F.col("toolName").isin(*WRITE_TOOLS)
    check = (F.col("toolName") == "Bash") & F.col("verificationKind").isNotNull() & (F.col("verificationKind") != "other")
    return e.join(epoch, "file", "left").where(impl | check).select(
        F.coalesce("sessionId", "file").alias("session_id"), F.lit("hooks").alias("source"), F.col("line_no").alias("seq"), F.when(impl, "implementation").otherwise("verification").alias("event_type"),
        (F.col("_ms") - F.col("_epoch")).alias("ts_offset"), F.col("toolName").alias("tool_name"), F.when(impl, F.col("ok")).otherwise(F.coalesce("ok", F.col("testsFailedCount") == 0)).alias("ok"),
        F.when(check, F.col("verificationKind")).alias("verification_kind"), F.when(impl & F.coalesce("changeFingerprint", "fileHash").isNotNull(), 1).alias("changed_files"),
        F.when(impl, F.coalesce("changeFingerprint", "fileHash")).alias("change_hash"), F.when(impl, F.coalesce("fingerprintBasis", F.when(F.col("fileHash").isNotNull(), "path"))).alias("fingerprint_basis"),
        F.lit(None).cast("string").alias("failure_sig"), F.when(check, F.col("testsFailedCount")).alias("tests_failed"), F.lit(None).cast("double").alias("duration_ms"),
        F.when(impl, F.col("turn")).alias("turn"), F.when(impl, F.col("testOnly")).alias("test_only"), F.lit(None).cast("string").alias("path"),
    )


__all__ = ["claude_events", "codex_events", "ellipsis", "generic_events", "hook_replay_events"]
