"""Project hook packets as trace records, receipts with their scopes, and gaps.

Packets (line_no, raw) of all sessions are parsed once. A turn ends with a stop or a failure, and the next tool packet opens another: turns are
running counts over (session, line). A result meets the last call of its id since the stop before; the first result of an id in a
turn counts, and its own input stands in for a call that was lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import answer_hash, native_id, normalize_answer
from ..operators.ordered import last_seen, ordered_scan, running_sum
from ..runtime import stage
from .native_streams import CLAUDE_TOOLS, SUMMARY_CHARS, Capture, _HITS, _links, _text

# Hook events.
TOOL_EVENTS = ("PreToolUse", "PostToolUse", "PostToolUseFailure")
EVENTS = ("SessionStart", *TOOL_EVENTS, "Stop", "StopFailure", "SessionEnd")
_PACKET = (
    "session_id string, hook_event_name string, agent_id string, tool_use_id string, tool_name string, tool_input struct<query:string,url:string,file_path:string>, "
    "tool_response string, stop_hook_active boolean, last_assistant_message string"
)
_ADAPTER = "claude-code"


def _turns(lines: DataFrame) -> DataFrame:
    p = F.from_json("raw", _PACKET)
    rows = lines.select("line_no", p.alias("p")).select("line_no", "p.*").where((F.coalesce("session_id", F.lit("")) != "") & F.col("hook_event_name").isin(*EVENTS))
    name, own = F.col("hook_event_name"), F.col("agent_id").isNull()
    kind = F.when(own & name.isin(*TOOL_EVENTS), "T").when(own & (name == "Stop"), "C").when(own & (name == "StopFailure"), "F")
    rows = stage(rows.withColumns({"run_id": F.concat(F.lit("run-claude-hook-"), native_id("session_id")), "kind": kind, "slice": F.floor(F.col("line_no") / 65_536)}))

    def scan(df: DataFrame, **scans) -> DataFrame:
        return ordered_scan(df, ["run_id"], ["line_no"], "slice", **scans)

    rows = scan(rows, worked=last_seen(F.col("kind"), F.col("kind").isin("T", "F")), place=running_sum(F.lit(1)))
    said = (F.coalesce("last_assistant_message", F.lit("")) != "") & ~F.coalesce("stop_hook_active", F.lit(False)) & ~F.coalesce(F.col("worked") == "F", F.lit(False))
    rows = rows.withColumn("mark", F.when(F.col("kind").isin("T", "F"), F.col("kind")).when((F.col("kind") == "C") & said, "S"))
    rows = scan(rows, before=last_seen(F.col("mark"), F.col("mark").isNotNull()))
    opens = ((F.col("mark") == "T") & F.col("before").isin("S", "F")) | ((F.col("mark") == "S") & (F.col("before") == "S"))
    rows = rows.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))
    rows = scan(rows, opened=running_sum(F.col("opens")), stops=running_sum(F.coalesce(F.col("kind") == "C", F.lit(False)).cast("int"), inclusive=False))
    return stage(rows.withColumn("turn", F.col("opened") + 1).drop("slice"))


def _given(source: str) -> Column:
    """What a known tool was asked for."""
    out = F.lit(None).cast("string")
    for tool, (_, field) in CLAUDE_TOOLS.items():
        out = F.when(F.col("tool_name") == tool, normalize_answer(_text(F.col(f"{source}.{field}")))).otherwise(out)
    return out


def hook_capture(lines: DataFrame) -> Capture:
    """Trace records of hook packets. Packets of no known hook or without a session are passed over."""
    rows = _turns(lines)
    gaps: list[DataFrame] = []

    def gap(found: DataFrame, code: str) -> None:
        gaps.append(found.select("run_id", F.lit(code).alias("code")))

    gap(rows.where("place = 1 AND hook_event_name <> 'SessionStart'"), "NATIVE_BOUNDARY")
    gap(rows.where(F.col("agent_id").isNotNull() & (F.col("hook_event_name") != "SessionStart")), "NATIVE_NESTED")
    gap(rows.where("kind = 'F'"), "NATIVE_FAILED")
    gap(rows.where("kind = 'C' AND mark IS NULL"), "NATIVE_BOUNDARY")
    tools = rows.where("kind = 'T'").withColumn("id", normalize_answer(_text(F.col("tool_use_id"))))
    gap(tools.where("id IS NULL"), "NATIVE_DRIFT")
    known = F.coalesce(F.col("tool_name").isin(*CLAUDE_TOOLS), F.lit(False))
    gap(tools.where(F.col("id").isNotNull() & ~known), "NATIVE_UNKNOWN_TOOL")
    tools = tools.where(F.col("id").isNotNull() & known)

    asked = tools.where("hook_event_name = 'PreToolUse'").select("run_id", "turn", "stops", "id", "line_no", _given("tool_input").alias("given"))
    response, failed = F.col("tool_response"), F.col("hook_event_name") == "PostToolUseFailure"
    groups = F.from_json(F.get_json_object(response, "$.results"), f"array<struct<content:{_HITS}>>")
    hits = F.flatten(F.transform(F.filter(groups, lambda g: g["content"].isNotNull()), lambda g: g["content"]))
    parts = F.array_join(F.transform(F.from_json(response, "array<struct<type:string,text:string>>"), lambda x: F.when(x["type"] == "text", x["text"])), "\n")
    inner = F.when(F.col("tool_name") == "WebFetch", F.get_json_object(response, "$.result")).when(F.col("tool_name") == "Read", F.get_json_object(response, "$.file.content"))
    content = F.when(F.startswith(response, F.lit("[")), parts).when(F.startswith(response, F.lit("{")), inner).otherwise(response)
    searched = (F.col("tool_name") == "WebSearch") & hits.isNotNull()
    nothing = F.array().cast("array<struct<source_id:string,url:string,title:string,rank:int>>")
    heard = tools.where("hook_event_name <> 'PreToolUse'").select(
        "run_id", "turn", "stops", "id", "line_no", "tool_name", failed.alias("failed"), (content.isNotNull() | searched | failed).alias("readable"), _given("tool_input").alias("own"),
        F.substring(_text(F.coalesce(content, F.when(failed, "Native tool failure"))), 1, SUMMARY_CHARS).alias("content"), F.when(searched & ~failed, _links(hits)).otherwise(nothing).alias("links"),
    )
    gap(heard.where("NOT readable"), "NATIVE_DRIFT")
    first = heard.where("readable").groupBy("run_id", "turn", "id").agg(F.min_by(F.struct("line_no", "stops", "tool_name", "failed", "own", "content", "links"), "line_no").alias("r"))
    first = stage(first)
    near = first.select("run_id", "turn", "id", F.col("r.stops").alias("stops"), F.col("r.line_no").alias("_at"))
    call = asked.join(near, ["run_id", "turn", "stops", "id"]).where("line_no < _at").groupBy("run_id", "turn", "id").agg(F.max_by(F.struct("given"), "line_no").alias("c"))
    met = first.join(call, ["run_id", "turn", "id"], "left").withColumn("given", F.when(F.col("c").isNotNull(), F.col("c.given")).otherwise(F.col("r.own")))
    met = stage(met)
    gap(met.where("given IS NULL"), "NATIVE_UNKNOWN_TOOL")
    open_calls = asked.join(near.select("run_id", "turn", "stops", "id", "_at"), ["run_id", "turn", "stops", "id"], "left").where("_at IS NULL OR line_no > _at")
    open_calls = stage(open_calls.select("run_id", "turn", "stops").distinct())
    gap(rows.where("kind = 'C'").select("run_id", (F.col("turn") - F.col("opens")).alias("turn"), "stops").join(open_calls, ["run_id", "turn", "stops"]), "NATIVE_MISSING_RESULT")

    search = F.col("r.tool_name") == "WebSearch"
    place = F.when(~search, F.col("given"))
    events = stage(met.where("given IS NOT NULL").select(
        "run_id", "turn", F.col("r.line_no").alias("at"), F.lit("event").alias("record_kind"), F.concat(F.lit("native-"), native_id("run_id", F.col("turn").cast("string"), "id")).alias("record_id"),
        F.when(search, "SEARCH").otherwise("READ").alias("type"), F.when(search, F.col("given")).alias("query"), place.alias("location"),
        F.concat(F.lit("source-"), native_id(F.coalesce(place, F.concat(F.lit(_ADAPTER + ":"), "id")))).alias("source_id"),
        F.when(F.startswith(place, F.lit("http")), "URL").when(place.isNotNull(), "FILE").otherwise("TOOL_RESULT").alias("source_kind"), F.when(F.col("r.failed"), "FAILED").otherwise("SUCCESS").alias("outcome"),
        F.when(~search, F.col("r.content")).alias("summary"), F.when(search, F.col("r.links")).alias("results"), F.col("id").alias("tool_call_id"), F.col("id").alias("tool_result_id"),
    ))
    final = rows.where("mark = 'S'").select("run_id", "turn", F.col("line_no").alias("at"), "session_id", normalize_answer(F.col("last_assistant_message")).alias("answer"), native_id("run_id", F.col("turn").cast("string")).alias("local"))
    claims = final.select("run_id", "turn", "at", F.lit("event").alias("record_kind"), F.concat(F.lit("claim-"), "local").alias("record_id"), F.lit("CLAIM").alias("type"), F.concat(F.lit("answer-"), "local").alias("source_id"), F.lit("UNKNOWN").alias("source_kind"), "answer")
    receipts = final.select("run_id", "turn", "at", F.lit("answer").alias("record_kind"), F.concat(F.lit("receipt-"), "local").alias("record_id"), F.concat(F.lit("answer-"), "local").alias("answer_id"),
                            F.col("session_id").alias("session"), "answer", answer_hash(F.col("answer")).alias("answer_hash"), F.lit(True).alias("scope_declared"))
    scope = receipts.select("run_id", "turn", F.col("record_id").alias("receipt_id")).join(events.select("run_id", "turn", F.col("record_id").alias("event_id"), "at").union(claims.select("run_id", "turn", "record_id", "at")), ["run_id", "turn"])

    ends = rows.where("agent_id IS NULL AND hook_event_name = 'SessionEnd'")
    waiting = open_calls.withColumn("waits", F.lit(True))
    ends = ends.join(waiting, ["run_id", "turn", "stops"], "left").select("run_id", "line_no", "before", "waits")
    gap(ends.where("NOT (before <=> 'S') OR waits"), "NATIVE_BOUNDARY")
    closed = ends.select("run_id", F.col("line_no").alias("at"), F.lit("run").alias("record_kind"), F.when(F.col("before") == "F", "FAILED").when(F.col("before") == "S", "COMPLETED").otherwise("CANCELLED").alias("lifecycle"))
    opened = rows.where("place = 1 OR hook_event_name = 'SessionStart'").select("run_id", F.col("line_no").alias("at"), F.lit("run").alias("record_kind"), F.lit("RUNNING").alias("lifecycle"))
    records = events
    for more in (claims, receipts, opened, closed):
        records = records.unionByName(more, allowMissingColumns=True)
    last = closed.groupBy("run_id").agg(F.max_by("lifecycle", "at").alias("lifecycle"))
    runs = rows.select("run_id").distinct().join(last, "run_id", "left").select("run_id", F.coalesce("lifecycle", F.lit("RUNNING")).alias("lifecycle"))
    return Capture(records, scope.select("run_id", "receipt_id", "event_id", "at"), reduce(DataFrame.union, gaps).distinct(), runs)
