"""Agent session logs as replay events (``tracelake.schemas.REPLAY_EVENT``), without text of the session.

The raw lines are parsed once into a stored table of typed columns; every later step reads columns of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.commands import classify_verification, display_path, extract_failed_count, failure_signature, only_test_paths
from ..functions.hashing import change_fingerprint, path_fingerprint
from ..operators.ordered import last_seen, ordered_scan, running_sum
from ..runtime import stage
from ..schemas import REPLAY_EVENT
from .session_logs import WRITE_TOOLS, _chunk, _millis, _text_of

_SPOKEN = ("assistant", "user")
_LINE = (
    "type string, timestamp string, sessionId string, cwd string, message struct<content:string>, "
    "toolUseResult struct<stderr:string,durationMs:double>"
)
_BLOCKS = "array<struct<type:string,name:string,id:string,tool_use_id:string,is_error:boolean,input:string,content:string>>"
_INPUT = (
    "file_path string, old_string string, new_string string, content string, new_source string, command string, "
    "edits array<struct<old_string:string,new_string:string>>"
)


def change_identity(i: Column, secret: str | None) -> tuple[Column, Column, Column, Column]:
    """Of a tool input: distinct paths, how many, and hash and basis of the change (both null without a key).

    The content of the change decides where the input has any; else the paths do.
    """
    listed = F.from_json(i["file_path"], "array<string>")
    paths = F.array_distinct(F.when(F.startswith(i["file_path"], F.lit("[")), listed).when(i["file_path"].isNotNull(), F.array(i["file_path"])).otherwise(F.array().cast("array<string>")))
    pairs = F.flatten(F.transform(
        F.filter(F.coalesce(i["edits"], F.array().cast("array<struct<old_string:string,new_string:string>>")), lambda e: e["old_string"].isNotNull() & e["new_string"].isNotNull()),
        lambda e: F.array(e["old_string"], e["new_string"]),
    ))
    edit = i["old_string"].isNotNull() & i["new_string"].isNotNull()
    op = F.when(edit, "edit").when(i["content"].isNotNull(), "write").when(i["new_source"].isNotNull(), "notebook").when(F.size(pairs) > 0, "multi-edit")
    parts = F.when(edit, F.array(i["old_string"], i["new_string"])).when(i["content"].isNotNull(), F.array(i["content"])).when(i["new_source"].isNotNull(), F.array(i["new_source"])).otherwise(pairs)
    count = F.when(F.size(paths) > 0, F.size(paths))
    if secret is None:
        nothing = F.lit(None).cast("string")
        return paths, count, nothing, nothing
    by_path = F.when(F.size(paths) > 0, path_fingerprint(paths, secret))
    value = F.when(op.isNotNull(), change_fingerprint(op, parts, secret)).otherwise(by_path)
    return paths, count, value, F.when(op.isNotNull(), "content").when(F.size(paths) > 0, "path")


def claude_replay(lines: DataFrame, secret: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chat-style log as replay events, and one row of facts per file.

    A message with at least one change is one turn. A call takes its first result, met by its id.
    """
    body = F.from_json("raw", _LINE)
    seen = lines.where(F.col("raw") != "").select("file", "line_no", body.alias("j"))
    rows = stage(seen.select(
        "file", "line_no", "j.type", "j.sessionId", "j.cwd", "j.timestamp", _millis(F.col("j.timestamp")).alias("ts_ms"), F.col("j.message.content").alias("content"),
        F.col("j.toolUseResult.stderr").alias("stderr"), F.col("j.toolUseResult.durationMs").alias("duration_ms"),
    ))
    spoken = F.coalesce(F.col("type").isin(*_SPOKEN), F.lit(False))
    dated = F.when(spoken & F.col("ts_ms").isNotNull(), F.col("line_no"))
    facts = rows.groupBy("file").agg(
        F.substring(F.coalesce(F.max_by("sessionId", F.when(F.col("sessionId").isNotNull(), F.col("line_no"))), F.lit("session")), 1, 8).alias("session_id"),
        F.count("*").alias("lines"), F.count_if(spoken).alias("parsed_lines"), F.min_by("ts_ms", dated).alias("started_ms"), F.min_by("timestamp", dated).alias("started_at"),
        F.max(F.when(spoken, F.col("ts_ms"))).alias("last_ms"),
    )
    folders = ordered_scan(rows.select("file", "line_no", "cwd"), ["file"], ["line_no"], _chunk(), folder=last_seen(F.col("cwd"), F.col("cwd") != "", inclusive=True))
    blocks = stage(
        rows.where(spoken & F.startswith("content", F.lit("[")))
        .select("file", "line_no", "type", "ts_ms", "stderr", "duration_ms", F.posexplode(F.from_json("content", _BLOCKS)).alias("pos", "b"))
        .where(((F.col("type") == "assistant") & (F.col("b.type") == "tool_use") & F.col("b.name").isNotNull()) | ((F.col("type") == "user") & (F.col("b.type") == "tool_result")))
        .select("file", "line_no", "pos", "type", "ts_ms", "stderr", "duration_ms", "b.name", "b.id", "b.tool_use_id", "b.is_error", "b.input", "b.content")
    )
    i = F.col("i")
    calls = blocks.where("type = 'assistant'").select("file", "line_no", "pos", "ts_ms", F.col("name").alias("tool_name"), F.col("id").alias("call"), F.from_json("input", _INPUT).alias("i"))
    calls = calls.join(folders.select("file", "line_no", "folder"), ["file", "line_no"])
    paths, count, value, basis = change_identity(i, secret)
    impl, shell = F.col("tool_name").isin(*WRITE_TOOLS), F.col("tool_name") == "Bash"
    kind = F.when(shell, classify_verification(F.coalesce(i["command"], F.lit(""))))
    calls = calls.select(
        "file", "line_no", "pos", "ts_ms", "tool_name", "call", impl.alias("impl"), kind.alias("verification_kind"),
        F.when(impl, "implementation").when(shell & kind.isNotNull(), "verification").when(shell, "other").otherwise("observation").alias("event_type"),
        F.when(impl, count).alias("changed_files"), F.when(impl, value).alias("change_hash"), F.when(impl, basis).alias("fingerprint_basis"),
        F.when(impl, only_test_paths(paths)).alias("test_only"),
        F.when(~shell & i["file_path"].isNotNull() & (impl | (i["file_path"] != "")) & ~F.startswith(i["file_path"], F.lit("[")), display_path(i["file_path"], F.col("folder"))).alias("path"),
    )
    numbered = stage(ordered_scan(calls, ["file"], ["line_no", "pos"], _chunk(), seq=running_sum(F.lit(1))))
    changing = numbered.where("impl").select("file", "line_no").distinct()
    turns = ordered_scan(changing, ["file"], ["line_no"], _chunk(), turn=running_sum(F.lit(1)))
    answers = blocks.where("type = 'user'").select(
        "file", F.col("tool_use_id").alias("call"), F.struct(
            F.col("line_no"), F.col("pos"), F.coalesce("is_error", F.lit(False)).alias("failed"), F.col("duration_ms"),
            F.concat(F.coalesce("stderr", F.lit("")), F.lit("\n"), _text_of(F.col("content"))).alias("output"),
        ).alias("r"),
    )
    # only changes and shell calls wait for a result; what a reading gave says nothing
    waiting = numbered.where(F.col("impl") | (F.col("tool_name") == "Bash"))
    first = waiting.select("file", "call", F.col("line_no").alias("_at")).join(answers, ["file", "call"]).where("r.line_no > _at").groupBy("file", "call").agg(F.min("r").alias("r"))
    done, failed, check = F.col("r").isNotNull(), F.col("r.failed"), F.col("event_type") == "verification"
    events = numbered.join(first, ["file", "call"], "left").join(turns, ["file", "line_no"], "left").join(facts.select("file", "session_id", "started_ms"), "file")
    made = {
        "source": F.lit("claude"), "ts_offset": F.col("ts_ms") - F.col("started_ms"), "ok": F.when(done, ~failed), "duration_ms": F.col("r.duration_ms"),
        "failure_sig": F.when(check & failed, failure_signature(F.col("r.output"))),
        "tests_failed": F.when(check & failed, extract_failed_count(F.col("r.output"))).when(check & done & (F.col("verification_kind") == "test"), 0),
        "turn": F.when(F.col("impl"), F.col("turn")),
    }
    names = [c.strip().split(" ") for c in REPLAY_EVENT.split(",")]
    return events.select("file", *[made.get(n, F.col(n)).cast(t).alias(n) for n, t in names]), facts


def corpus_survey(lines: DataFrame) -> DataFrame:
    """Histograms of a chat-style log corpus: facet, key, n.

    Facets: ``line_type``, ``key`` (type and key of a line), ``block_type``, ``tool_name``, ``first_word`` of shell commands, ``edit`` (how
    a change is given), ``pairing`` of calls and results by id within a file, and ``session_files`` (how many files a session is in).
    """
    fields = F.from_json("raw", "map<string,string>")
    rows = lines.where(F.col("raw") != "").select("file", fields.alias("m"))
    rows = rows.select("file", "m", F.coalesce(F.try_element_at("m", F.lit("type")), F.lit("unreadable")).alias("type"))
    content = F.get_json_object(F.try_element_at("m", F.lit("message")), "$.content")
    rows = stage(rows.select("file", "type", F.map_keys("m").alias("keys"), F.try_element_at("m", F.lit("sessionId")).alias("session"), F.from_json(F.when(F.startswith(content, F.lit("[")), content), _BLOCKS).alias("blocks")))

    def facet(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), key.cast("string").alias("key"))

    per_line = F.concat(F.array(facet("line_type", F.col("type"))), F.coalesce(F.transform("keys", lambda k: facet("key", F.concat("type", F.lit("."), k))), F.array().cast("array<struct<facet:string,key:string>>")))
    blocks = rows.select("file", F.explode("blocks").alias("b")).select("file", "b.*", F.from_json("b.input", _INPUT).alias("i"))
    command = F.regexp_extract("i.command", r"^\s*(\S+)", 1)
    edit = F.when(F.col("i.old_string").isNotNull(), "replace").when(F.col("i.content").isNotNull(), "whole").when(F.col("i.new_source").isNotNull(), "cell").when(F.size("i.edits") > 0, "many").otherwise("other")
    per_block = F.filter(
        F.array(
            facet("block_type", F.col("type")), F.when(F.col("name").isNotNull(), facet("tool_name", F.col("name"))), F.when(command != "", facet("first_word", command)),
            F.when(F.col("name").isin(*WRITE_TOOLS), facet("edit", edit)),
        ),
        lambda x: x.isNotNull(),
    )
    counted = rows.select(F.explode(per_line).alias("f")).union(blocks.select(F.explode(per_block).alias("f"))).groupBy("f.facet", "f.key").agg(F.count("*").alias("n"))
    ids = blocks.select("file", F.coalesce("id", "tool_use_id").alias("call"), (F.col("type") == "tool_use").alias("asked")).where("call is not null")
    sides = ids.groupBy("file", "call").agg(F.bool_or("asked").alias("asked"), F.bool_or(~F.col("asked")).alias("answered"))
    state = F.when(F.col("asked") & F.col("answered"), "paired").when(F.col("asked"), "unanswered").otherwise("unasked")
    pairing = sides.groupBy(state.alias("key")).agg(F.count("*").alias("n")).select(F.lit("pairing").alias("facet"), "key", "n")
    spread = rows.where("session is not null").select("session", "file").distinct().groupBy("session").agg(F.count("*").cast("string").alias("key"))
    overlap = spread.groupBy("key").agg(F.count("*").alias("n")).select(F.lit("session_files").alias("facet"), "key", "n")
    return counted.union(pairing).union(overlap)
