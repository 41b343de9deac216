"""Rollout logs as replay events (``tracelake.schemas.REPLAY_EVENT``), token records and facts of each file.

The raw lines are parsed once into a stored table. Calls, outputs and boundaries are columns of that: the turn of a change is a running
count of boundary lines, and an output answers the nearest line before it that has its call id, if that is a call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.commands import classify_verification, embedded_command, exit_code, extract_failed_count, failure_signature, is_mobile_command, only_test_paths
from ..functions.hashing import change_fingerprint, lf
from ..operators.ordered import last_seen, ordered_scan, running_sum
from ..runtime import stage
from ..schemas import REPLAY_EVENT
from .session_logs import _chunk, _millis, _text_of

_LINE = (
    "type string, timestamp string, payload struct<type:string,id:string,call_id:string,name:string,input:string,arguments:string,output:string,"
    "thread_token_usage:struct<total_tokens:double>>"
)
# Tool names, patch marks, and outputs of commands that never ran.
PATCH_TOOLS = ("apply_patch", "Edit", "Write")
PROGRAM_TOOLS = ("exec", "shell_command")
_CALLS, _OUTPUTS = ("custom_tool_call", "function_call"), ("custom_tool_call_output", "function_call_output")
_PATCH = r"\*\*\* Begin Patch[\s\S]*?\*\*\* End Patch"
_PATCH_PATH = r"(?m)^\*\*\* (?:Update|Add|Delete) File: ([^\r\n]+)$"
_PROGRAM_PATH = r"(?m)^\s*\*{3}\s*(?:Update|Add|Delete) File:\s*(.+?)\s*\\n?$"
_NEVER_RAN = r"(?i)orchestrator_helper_launch_failed|windows sandbox:[^\n]*launch"
_NO_TEXTS = "array<string>"


def _paths(text: Column, pattern: str) -> Column:
    """Distinct non-empty paths of the file marks of a patch, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda p: F.trim(F.regexp_replace(p, r"\\n$|\s+$", "")))
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def _parsed(lines: DataFrame) -> DataFrame:
    body = F.from_json("raw", _LINE)
    rows = lines.where(F.col("raw") != "").select("file", "line_no", body.alias("j")).where("j.payload is not null")
    return stage(rows.select(
        "file", "line_no", "j.type", _millis(F.col("j.timestamp")).alias("ts_ms"), F.col("j.payload.type").alias("kind"), F.col("j.payload.id").alias("id"),
        F.col("j.payload.call_id").alias("call_id"), "j.payload.name", "j.payload.input", "j.payload.arguments", "j.payload.output",
        F.col("j.payload.thread_token_usage.total_tokens").cast("bigint").alias("total_tokens"),
    ))


def _facts(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for each file: session, times of its dated lines, whether it has turns, and whether a command is about mobile devices."""
    dated = ~F.coalesce(F.col("type").isin("turn_context", "session_meta"), F.lit(False)) & F.col("ts_ms").isNotNull()
    named = (F.col("type") == "session_meta") & F.col("id").isNotNull()
    facts = rows.groupBy("file").agg(
        F.substring(F.coalesce(F.max_by("id", F.when(named, F.col("line_no"))), F.lit("codex")), 1, 8).alias("session_id"),
        F.min_by("ts_ms", F.when(dated, F.col("line_no"))).alias("epoch_ms"), F.max(F.when(dated, F.col("ts_ms"))).alias("last_ms"),
        F.coalesce(F.bool_or(F.col("type") == "turn_context"), F.lit(False)).alias("turn_aware"),
    )
    mobile = calls.groupBy("file").agg(F.bool_or(F.coalesce(is_mobile_command(F.col("command")), F.lit(False))).alias("_mobile"))
    return facts.join(mobile, "file", "left").withColumn("mobile", F.coalesce("_mobile", F.lit(False))).drop("_mobile")


def _calls(rows: DataFrame) -> DataFrame:
    """Calls that become events: patches with their paths, and commands with the kind of check that they are."""
    given = rows.where((F.col("type") == "response_item") & F.col("kind").isin(*_CALLS) & F.col("name").isin(*PATCH_TOOLS, *PROGRAM_TOOLS))
    argument = {k: F.get_json_object("arguments", f"$.{k}") for k in ("input", "patch", "command")}
    is_patch = F.col("name").isin(*PATCH_TOOLS)
    patch = F.when(is_patch, F.coalesce("input", argument["input"], argument["patch"], F.lit("")))
    program = F.when(F.col("name") == "exec", F.col("input"))
    listed = F.array_join(F.from_json(argument["command"], _NO_TEXTS), " ")
    shell = F.when(F.col("name") == "shell_command", F.when(F.startswith(argument["command"], F.lit("[")), listed).otherwise(argument["command"]))
    bodies = F.when(is_patch, F.array(patch)).otherwise(F.regexp_extract_all(program, F.lit(_PATCH), F.lit(0)))
    rows = given.select(
        "file", "line_no", "ts_ms", "name", F.coalesce("call_id", "id", F.lit("")).alias("call"), is_patch.alias("is_patch"),
        F.coalesce(bodies, F.array().cast(_NO_TEXTS)).alias("bodies"), F.nullif(shell, F.lit("")).alias("shell"), embedded_command(program).alias("inner"),
    )
    listed = F.flatten(F.transform("bodies", lambda b: _paths(lf(b), _PROGRAM_PATH)))
    paths = F.when(F.col("is_patch"), _paths(F.get("bodies", 0), _PATCH_PATH)).otherwise(F.array_distinct(listed))
    check = F.coalesce(classify_verification(F.col("shell")), F.col("inner.kind"))
    return stage(rows.select("file", "line_no", "ts_ms", "name", "call", "is_patch", "bodies", paths.alias("paths"), check.alias("check"), F.coalesce("shell", "inner.command").alias("command")))


def _answers(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, line_no of the call, output): the first output after each call, unless a call of the same id comes between."""
    outputs = rows.where((F.col("type") == "response_item") & F.col("kind").isin(*_OUTPUTS) & F.col("call_id").isNotNull())
    both = calls.select("file", "call", "line_no", F.lit(True).alias("asks")).union(outputs.select("file", F.col("call_id"), "line_no", F.lit(False)))
    before = ordered_scan(both, ["file", "call"], ["line_no"], _chunk(), before=last_seen(F.struct("line_no", "asks")))
    met = before.where("NOT asks AND before.asks").select("file", "line_no", F.col("before.line_no").alias("at"))
    texts = outputs.select("file", "line_no", _text_of(F.col("output")).alias("output"))
    return met.join(texts, ["file", "line_no"]).select("file", F.col("at").alias("line_no"), "output")


def codex_replay(lines: DataFrame, secret: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rollout log as replay events, token records (file, session_id, ts_ms, record_no, total_tokens), and facts of each file.

    A patch, alone or inside a program, is a change; a command that reads as a check, alone or called by a program, is a
    verification; other commands are ``other``. A check whose command never ran is no check. Lines that are not JSON or have no
    payload are passed over; without ``secret`` changes have no hash.
    """
    rows = _parsed(lines)
    calls = _calls(rows)
    facts = _facts(rows, calls)
    tokens = rows.where("type = 'token_usage_record' AND total_tokens IS NOT NULL AND ts_ms IS NOT NULL").join(facts.select("file", "session_id"), "file")
    tokens = tokens.select("file", "session_id", "ts_ms", F.col("line_no").alias("record_no"), "total_tokens")

    changed, check = F.size("bodies") > 0, F.col("check")
    kinds = F.when(F.col("is_patch"), F.array(F.lit("implementation"))).otherwise(F.filter(
        F.array(F.when(changed, "implementation"), F.when(check.isNotNull(), "verification").when(~changed, "other")), lambda k: k.isNotNull()))
    events = calls.select("*", F.posexplode(kinds).alias("sub", "event_type"))
    boundaries = rows.where("type = 'turn_context'").select("file", "line_no", F.lit(0).alias("sub"), F.lit(True).alias("boundary"))
    marked = events.withColumn("boundary", F.lit(False)).unionByName(boundaries, allowMissingColumns=True)
    own = (~F.col("boundary")).cast("int")
    numbered = ordered_scan(marked, ["file"], ["line_no", "sub"], _chunk(), seq=running_sum(own), turns=running_sum(1 - own)).where("NOT boundary")
    joined = numbered.join(_answers(rows, calls), ["file", "line_no"], "left").join(facts.select("file", "session_id", "epoch_ms"), "file")

    was_check, change = F.col("event_type") == "verification", F.col("event_type") == "implementation"
    never = was_check & F.coalesce(F.col("output").rlike(_NEVER_RAN), F.lit(False))
    ran = was_check & ~never
    code = F.when(ran, exit_code(F.col("output")))
    failed, passed = F.coalesce(code != 0, F.lit(False)), F.coalesce(code == 0, F.lit(False))
    value = F.lit(None).cast("string") if secret is None else F.when(change, change_fingerprint(F.lit("patch"), F.col("bodies"), secret))
    made = {
        "source": F.lit("codex"), "event_type": F.when(never, "other").otherwise(F.col("event_type")), "ts_offset": F.col("ts_ms") - F.col("epoch_ms"),
        "tool_name": F.when(change, "apply_patch").otherwise(F.col("name")), "ok": code == 0, "verification_kind": F.when(ran, check),
        "changed_files": F.when(change, F.size("paths")), "change_hash": value,
        "fingerprint_basis": F.when(change & (F.col("is_patch") | (F.size("paths") > 0)), "content"),
        "failure_sig": F.when(failed, failure_signature(F.col("output"))),
        "tests_failed": F.when(failed, extract_failed_count(F.col("output"))).when(passed & (check == "test"), 0),
        "duration_ms": F.lit(None), "turn": F.when(change & (F.col("turns") > 0), F.col("turns")), "test_only": F.when(change, only_test_paths(F.col("paths"))),
        "path": F.when(change, F.get("paths", 0)),
    }
    names = [c.strip().split(" ") for c in REPLAY_EVENT.split(",")]
    return joined.select("file", *[made.get(n, F.col(n) if n in joined.columns else F.lit(None)).cast(t).alias(n) for n, t in names]), tokens, facts
