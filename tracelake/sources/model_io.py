"""Model request logs as session events: each line is a request window with the history so far, and its response.

Windows repeat earlier tool results; a result counts once, where it is first seen, and only if its call was made on an
earlier line. Lines are parsed once into a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.commands import classify_verification, display_path, extract_failed_count
from ..functions.text import first_line
from ..operators.ordered import ordered_scan, running_sum
from ..runtime import stage
from ..schemas import SESSION_EVENT
from .session_logs import READ_TOOLS, _chunk, _millis

# What a change makes of its file, and the tools that start another agent.
CHANGES = {"Edit": "FILE_CHANGED", "MultiEdit": "FILE_CHANGED", "Write": "FILE_CREATED", "NotebookEdit": "FILE_CREATED"}
SPAWN_TOOLS = ("Agent", "Task")
_LINE = (
    "sessionId string, startedAt string, request struct<messages:array<struct<role:string,content:string,toolCallId:string,isError:boolean>>>, "
    "response struct<text:string,toolCalls:array<struct<id:string,name:string,input:string>>>"
)
_INPUT = "file_path string, path string, notebook_path string, command string, description string, prompt string"
_COLUMNS = [c.strip().split(" ") for c in SESSION_EVENT.split(",")]


def _says(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def model_io_events(lines: DataFrame) -> DataFrame:
    """Session events with the file and line they come from; unreadable lines and lines without a time are left out."""
    j = F.from_json("raw", _LINE)
    rows = lines.where(F.trim("raw") != "").select("file", "line_no", j.alias("j")).select(
        "file", "line_no", _millis(F.col("j.startedAt")).alias("ts_ms"), F.col("j.sessionId").alias("sid"), F.col("j.request.messages").alias("messages"),
        F.col("j.response.text").alias("text"), F.col("j.response.toolCalls").alias("calls"),
    )
    rows = stage(rows.where("ts_ms is not null"))
    named = rows.where("sid is not null").groupBy("file").agg(F.min(F.struct("line_no", "sid")).alias("n"))
    bare = F.substring(F.regexp_replace("n.sid", "^sess_", ""), 1, 8)
    named = named.select("file", F.col("n.line_no").alias("_from"), F.when(bare != "", bare).otherwise(F.substring("n.sid", 1, 8)).alias("_sid"))
    opening = rows.groupBy("file").agg(F.min_by("messages", "line_no").alias("messages"), F.min_by("ts_ms", "line_no").alias("ts_ms"), F.min("line_no").alias("line_no"))
    base = ["file", "line_no", "ts_ms"]
    asked = F.filter(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: first_line(m["content"])), lambda t: ~F.startswith(t, F.lit("<")))
    task = opening.select(*base, F.try_element_at(asked, F.lit(-1)).alias("summary")).where("summary is not null").select(
        *base, F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit("main").alias("agent_id"), F.lit("MESSAGE").alias("type"), "summary", F.lit("user").alias("meta_role"))
    said = rows.where(F.trim("text") != "").select(
        *base, F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit("main").alias("agent_id"), F.lit("MESSAGE").alias("type"), first_line(F.col("text")).alias("summary"), F.lit("assistant").alias("meta_role"))

    i, name = F.col("i"), F.col("tool_name")
    made = rows.select(*base, F.posexplode("calls").alias("pos", "c")).where("c.name is not null").select(
        *base, "pos", F.col("c.name").alias("tool_name"), F.nullif(F.col("c.id"), F.lit("")).alias("call"), F.from_json("c.input", _INPUT).alias("i"))
    raw_path = F.coalesce(i["file_path"], i["path"], i["notebook_path"])
    change = F.coalesce(*[F.when(name == k, v) for k, v in CHANGES.items()])
    reads, runs, spawns = name.isin(*READ_TOOLS) & raw_path.isNotNull(), (name == "Bash") & i["command"].isNotNull(), name.isin(*SPAWN_TOOLS)
    made = made.select(
        *base, "pos", "call", "tool_name", F.when(change.isNotNull(), "file").when(reads, "read").when(runs, "command").when(spawns, "subagent").otherwise("tool").alias("kind"),
        change.alias("_change"), i["command"].alias("_command"), F.when(~runs & ~spawns, display_path(raw_path)).alias("file_path"),
        F.when(spawns, first_line(F.coalesce(i["description"], i["prompt"], F.lit("")), 120)).alias("meta_task"),
    ).withColumn("command", F.when(F.col("kind") == "command", F.col("_command"))).withColumn("check", classify_verification(F.col("command")))
    kind, check, path = F.col("kind"), F.col("check"), F.col("file_path")
    agent = F.when(kind == "subagent", _says("sub-", F.expr("right(coalesce(call, 'unseen'), 8)"))).otherwise("main")
    made = stage(made.withColumn("agent_id", agent))
    calls = made.select(
        *base, F.lit(3).alias("part"), "pos", "agent_id", F.when(kind == "subagent", "main").alias("parent_agent_id"), "call", "tool_name", "command", "file_path", "meta_task",
        F.when(kind == "file", F.col("_change")).when(kind == "read", "FILE_READ")
        .when(kind == "command", F.when(check == "test", "TEST_STARTED").when(check == "build", "BUILD_STARTED").otherwise("COMMAND_STARTED"))
        .when(kind == "subagent", "SUBAGENT_STARTED").otherwise("TOOL_CALLED").alias("type"),
        F.when(kind == "read", "ok").otherwise("running").alias("status"),
        F.when(kind == "file", _says(F.when(F.col("_change") == "FILE_CREATED", "Created ").otherwise("Modified "), F.coalesce(path, F.lit("(unknown file)"))))
        .when(kind == "read", _says("Read ", path)).when(kind == "command", _says("Ran ", F.col("command")))
        .when(kind == "subagent", F.coalesce(_says("Subagent started: ", F.col("meta_task")), F.lit("Subagent started")))
        .otherwise(F.coalesce(_says(name, " ", path), _says("Called ", name))).alias("summary"),
    )
    heard = rows.select(*base, F.posexplode("messages").alias("pos", "m")).where("m.role = 'tool' and m.toolCallId <> ''").select(
        "file", F.col("m.toolCallId").alias("call"), F.struct("line_no", "pos", "ts_ms", F.coalesce("m.isError", F.lit(False)).alias("bad"), F.coalesce("m.content", F.lit("")).alias("output")).alias("r"))
    heard = heard.groupBy("file", "call").agg(F.min("r").alias("r"))
    own = made.where("call is not null and kind <> 'read'").select("file", "call", F.struct("line_no", "pos", "agent_id", "tool_name", "command", "file_path", "kind", "check").alias("c"))
    pairs = own.join(heard, ["file", "call"]).where("c.line_no < r.line_no").groupBy("file", "call").agg(F.max("c").alias("c"), F.first("r").alias("r"))
    bad, label = F.col("r.bad"), first_line(F.coalesce("c.command", F.lit("tests")), 80)
    kind, check = F.col("c.kind"), F.col("c.check")
    failed = F.when(bad & (check == "test"), extract_failed_count(F.col("r.output")))
    results = pairs.where(kind.isin("command", "subagent") | bad).select(
        "file", F.col("r.line_no").alias("line_no"), F.col("r.ts_ms").alias("ts_ms"), F.lit(1).alias("part"), F.col("r.pos").alias("pos"), F.col("c.agent_id").alias("agent_id"),
        F.when(kind == "subagent", "main").alias("parent_agent_id"), F.when(kind != "subagent", F.col("call")).alias("answers"),
        F.when(kind == "command", F.when(check == "test", F.when(bad, "TEST_FAILED").otherwise("TEST_PASSED")).when(check == "build", F.when(bad, "BUILD_FAILED").otherwise("BUILD_PASSED")).otherwise("COMMAND_COMPLETED"))
        .when(kind == "subagent", "SUBAGENT_COMPLETED").otherwise("TOOL_RESULT").alias("type"),
        F.when(kind != "subagent", F.col("c.tool_name")).alias("tool_name"), F.col("c.command").alias("command"), F.when(kind.isin("file", "tool"), F.col("c.file_path")).alias("file_path"),
        F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, first_line(F.col("r.output"), 200)).alias("error"), failed.cast("double").alias("meta_tests_failed"),
        F.when(kind == "subagent", F.when(bad, "Subagent reported an error").otherwise("Subagent finished")).when(kind != "command", _says(F.col("c.tool_name"), " reported an error"))
        .when(check == "test", _says(label, " — ", F.when(~bad, "passed").when(failed == 1, "1 test failed").when(failed.isNotNull(), _says(failed.cast("string"), " tests failed")).otherwise("tests failed")))
        .when(check == "build", _says(label, F.when(bad, " — failed").otherwise(" — passed"))).otherwise(_says(first_line(F.coalesce("c.command", "c.tool_name"), 80), " finished")).alias("summary"),
    )
    every = task.unionByName(said, allowMissingColumns=True).unionByName(calls, allowMissingColumns=True).unionByName(results, allowMissingColumns=True)
    numbered = ordered_scan(every, ["file"], ["line_no", "part", "pos"], _chunk(), input_index=running_sum(F.lit(1)))
    numbered = stage(numbered.withColumn("id", _says("zc", F.lpad(F.col("input_index").cast("string"), 5, "0"))))
    asked_by = numbered.where("call is not null").groupBy("file", F.col("call").alias("answers")).agg(F.max_by("id", "input_index").alias("parent_id"))
    linked = numbered.join(asked_by, ["file", "answers"], "left").join(named, "file", "left")
    session = F.when(F.col("line_no") >= F.col("_from"), F.col("_sid")).otherwise("model-io-session")
    fixed, have = {"session_id": session, "source": F.lit("model-io")}, set(linked.columns)
    return linked.select("file", "line_no", *[(fixed[n] if n in fixed else F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in _COLUMNS])
