"""Registered source queries (SRC): the tables written as logs, and read back by the sources."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..sources import device, lines as L, model_io, replay_logs as P, session_logs as S
from . import bind
from .catalog_replay import events as replay_events
from .catalog_scalars import SECRET, _hmac
from .catalog_sessions import events as session_events


def session_log(s, d):
    """Session events as JSON lines, one file per session; every line whose index ends in 7 is torn."""
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    body = F.to_json(F.struct(
        "id", F.col("session_id").alias("sessionId"), F.col("agent_id").alias("agentId"), "type", stamp.alias("timestamp"), F.col("file_path").alias("filePath"),
        "command", "status", "error", F.col("exit_code").alias("exitCode"), F.struct(F.col("meta_role").alias("role")).alias("metadata"),
    ))
    return session_events(s, d).select(
        F.col("session_id").alias("file"), F.col("input_index").alias("line_no"),
        F.when(F.col("input_index") % 10 == 7, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body).alias("raw"),
    )


def hook_log(s, d):
    stamp = F.date_format(F.timestamp_millis("last_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    body = F.to_json(F.struct(
        stamp.alias("ts"), F.col("session_id").alias("sessionId"), F.col("tool_name").alias("toolName"), "ok", F.col("change_hash").alias("changeFingerprint"),
        F.col("fingerprint_basis").alias("fingerprintBasis"), F.col("verification_kind").alias("verificationKind"), F.col("tests_failed").alias("testsFailedCount"), "turn", F.col("test_only").alias("testOnly"),
    ))
    return replay_events(s, d).select(F.col("session_id").alias("file"), F.col("seq").alias("line_no"), body.alias("raw"))


def captures(s, d):
    k = F.col("k").cast("string")
    snap = F.concat(F.lit("Page: P"), (F.col("k") % 5).cast("string"), F.lit("\n@e1 [button] Go "), k, F.lit(" [enabled]\n@e2 [text] Hi"))
    logs = F.when(F.col("k") % 3 == 0, F.concat(F.lit("a.b.NullError: x\n at java.util.X.y(Z)\n at com.app.M"), k, F.lit(".run(M.kt:1)"))).otherwise("fine")
    return bind.raw_events(s, d).select(F.col("event_id").alias("attempt_id"), snap.alias("snapshot_text"), logs.alias("logs_text"))


def chat_log(s, d):
    """Events as a chat log, one file per user: a call and, for most, the result on the next line; every eleventh call line is torn."""
    e = bind.raw_events(s, d).withColumn("at", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    k, kind, text = F.col("k"), F.col("event_type"), F.col("k").cast("string")
    path = F.concat(F.lit("/w/src/m"), text, F.when(k % 3 == 0, ".test.ts").otherwise(".ts"))
    name = F.when(kind == "view", "Read").when(kind == "purchase", "Edit").when(kind == "signup", "Write").otherwise("Bash")
    shape = "struct<file_path:string,old_string:string,new_string:string,content:string,command:string>"
    given = F.struct(
        F.when(~kind.isin("click", "error"), path).alias("file_path"), F.when(kind == "purchase", text).alias("old_string"), F.when(kind == "purchase", F.concat(text, F.lit("x"))).alias("new_string"),
        F.when(kind == "signup", F.concat(F.lit("c"), text)).alias("content"), F.when(kind == "click", "npm test").when(kind == "error", "ls").alias("command"),
    ).cast(shape)
    call = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    said = F.to_json(F.struct(
        F.lit("assistant").alias("type"), F.col("at").alias("timestamp"), F.concat(F.lit("session-"), F.col("user_id").cast("string")).alias("sessionId"), F.lit("/w").alias("cwd"),
        F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), name.alias("name"), call.alias("id"), given.alias("input"))).alias("content")).alias("message"),
    ))
    said = F.when(F.col("event_id") % 11 == 0, F.substring(said, F.lit(1), F.length(said) - 1)).otherwise(said)
    bad = kind.isin("click", "error") & (k % 4 == 0)
    heard = F.when(k % 5 != 0, F.to_json(F.struct(
        F.lit("user").alias("type"), F.col("at").alias("timestamp"),
        F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), bad.alias("is_error"), F.concat(text, F.lit(" tests failed")).alias("content"))).alias("content")).alias("message"),
        F.struct(k.cast("double").alias("durationMs")).alias("toolUseResult"),
    )))
    lines = F.array(F.struct((F.col("event_id") * 2).alias("line_no"), said.alias("raw")), F.struct((F.col("event_id") * 2 + 1).alias("line_no"), heard.alias("raw")))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.inline(lines)).where("raw is not null")


def model_log(s, d):
    """Events as request windows, one file per user: each window repeats the results of the two calls before, and asks for one call."""
    e = bind.raw_events(s, d)
    k, kind, text = F.col("k"), F.col("event_type"), F.col("k").cast("string")
    name = F.when(kind == "view", "Grep").when(kind == "click", "Bash").when(kind == "error", "Bash").when(kind == "purchase", "Edit").otherwise("Task")
    given = F.struct(
        F.when(kind == "purchase", F.concat(F.lit("src/m"), text, F.lit(".ts"))).alias("file_path"), F.when(kind == "click", "npm test").when(kind == "error", "ls").alias("command"),
        F.when(kind == "signup", F.concat(F.lit("look at "), text)).alias("description"),
    )
    call = F.concat(F.lit("call-"), F.col("event_id").cast("string"))
    result = F.struct(F.lit("tool").alias("role"), F.concat(text, F.lit(" tests failed")).alias("content"), call.alias("toolCallId"), (k % 3 == 0).alias("isError"))
    e = e.withColumn("call", F.struct(call.alias("id"), name.alias("name"), given.alias("input"))).withColumn("result", result)
    past = Window.partitionBy("user_id").orderBy("event_id")
    user = F.struct(F.lit("user").alias("role"), F.lit("fix the build").alias("content"), F.lit(None).cast("string").alias("toolCallId"), F.lit(None).cast("boolean").alias("isError"))
    window = F.filter(F.array(user, F.lag("result", 2).over(past), F.lag("result", 1).over(past)), lambda m: m.isNotNull())
    raw = F.to_json(F.struct(
        F.concat(F.lit("sess_"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("sessionId"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("startedAt"),
        F.struct(window.alias("messages")).alias("request"), F.struct(F.when(k % 2 == 0, F.concat(F.lit("step "), text)).alias("text"), F.array("call").alias("toolCalls")).alias("response"),
    ))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line_no"), raw.alias("raw"))


def model_events(s, d):
    return model_io.model_io_events(model_log(s, d)).select(
        "file", "id", "session_id", "parent_id", "agent_id", "parent_agent_id", "type", "ts_ms", "input_index", "summary", "meta_role", "meta_tests_failed", "file_path", "command", "tool_name", "status", "error")


def chat_replay(s, d):
    return P.claude_replay(chat_log(s, d), SECRET)[0].drop("source")


QUERIES = {
    "src_model_io_events": model_events,
    "src_chat_replay": chat_replay,
    "rep_corpus_survey": lambda s, d: P.corpus_survey(chat_log(s, d)),
    "src_chat_replay_files": lambda s, d: P.claude_replay(chat_log(s, d))[1],
    "src_generic_events": lambda s, d: S.generic_events(session_log(s, d))[0].select("id", "session_id", "agent_id", "type", "ts_ms", "input_index", "file_path", "command", "status", "error", "exit_code", "meta_role", "source"),
    "src_tolerant_warnings": lambda s, d: L.scan_tolerant(session_log(s, d))[1],
    "src_detect_adapter": lambda s, d: L.detect_adapter(session_log(s, d)),
    "src_hook_events": lambda s, d: S.hook_replay_events(hook_log(s, d)).select("session_id", "seq", "event_type", "ok", "verification_kind", "change_hash", "tests_failed"),
    "src_device_captures": lambda s, d: device.capture_evidence(captures(s, d)),
}

_CHAT = """
WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
ln AS (SELECT *, event_id % 11 = 0 AS torn, k % 5 <> 0 AS heard FROM ev),
fs AS (SELECT user_id, arg_min(ts_ms, event_id * 2 + CAST(torn AS INT)) AS started_ms, max(ts_ms) AS last_ms FROM ln WHERE NOT torn OR heard GROUP BY 1)"""

ORACLES = {
    "src_model_io_events": """
WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
ln AS (SELECT *, row_number() OVER w AS i, lead(event_id) OVER w AS next_id, lead(ts_ms) OVER w AS next_ms, k % 3 = 0 AS bad,
  CASE event_type WHEN 'view' THEN 'Grep' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'Task' ELSE 'Bash' END AS tool, CASE event_type WHEN 'click' THEN 'npm test' WHEN 'error' THEN 'ls' END AS cmd,
  CASE WHEN event_type = 'purchase' THEN 'src/m' || k || '.ts' END AS path, CASE WHEN event_type = 'signup' THEN 'sub-' || right('call-' || event_id, 8) ELSE 'main' END AS agent FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
al AS (
  SELECT user_id, event_id AS line, ts_ms, 0 AS part, 'main' AS agent_id, 'MESSAGE' AS type, 'fix the build' AS summary, 'user' AS meta_role, NULL AS status, NULL AS tool_name, NULL AS command, NULL AS file_path, NULL AS error, NULL AS failed, NULL AS call, NULL AS answers, FALSE AS sub FROM ln WHERE i = 1
  UNION ALL SELECT user_id, event_id, ts_ms, 2, 'main', 'MESSAGE', 'step ' || k, 'assistant', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM ln WHERE k % 2 = 0
  UNION ALL SELECT user_id, event_id, ts_ms, 3, agent, CASE event_type WHEN 'purchase' THEN 'FILE_CHANGED' WHEN 'click' THEN 'TEST_STARTED' WHEN 'error' THEN 'COMMAND_STARTED' WHEN 'signup' THEN 'SUBAGENT_STARTED' ELSE 'TOOL_CALLED' END,
    CASE event_type WHEN 'purchase' THEN 'Modified ' || path WHEN 'signup' THEN 'Subagent started: look at ' || k WHEN 'view' THEN 'Called Grep' ELSE 'Ran ' || cmd END, NULL, 'running', tool, cmd, path, NULL, NULL, event_id, NULL, event_type = 'signup' FROM ln
  UNION ALL SELECT user_id, next_id, next_ms, 1, agent, CASE event_type WHEN 'click' THEN CASE WHEN bad THEN 'TEST_FAILED' ELSE 'TEST_PASSED' END WHEN 'error' THEN 'COMMAND_COMPLETED' WHEN 'signup' THEN 'SUBAGENT_COMPLETED' ELSE 'TOOL_RESULT' END,
    CASE event_type WHEN 'click' THEN 'npm test — ' || CASE WHEN bad THEN k || ' test' || CASE WHEN k = 1 THEN '' ELSE 's' END || ' failed' ELSE 'passed' END WHEN 'error' THEN 'ls finished' WHEN 'signup' THEN CASE WHEN bad THEN 'Subagent reported an error' ELSE 'Subagent finished' END ELSE tool || ' reported an error' END,
    NULL, CASE WHEN bad THEN 'error' ELSE 'ok' END, CASE WHEN event_type <> 'signup' THEN tool END, cmd, path, CASE WHEN bad THEN k || ' tests failed' END, CASE WHEN bad AND event_type = 'click' THEN CAST(k AS DOUBLE) END, NULL, CASE WHEN event_type <> 'signup' THEN event_id END, event_type = 'signup'
    FROM ln WHERE next_id IS NOT NULL AND (event_type IN ('click', 'error', 'signup') OR bad)),
nm AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line, part) AS n FROM al)
SELECT 'u' || a.user_id AS file, 'zc' || lpad(CAST(a.n AS VARCHAR), 5, '0') AS id, lpad(CAST(a.user_id AS VARCHAR), 8, '0') AS session_id, 'zc' || lpad(CAST(b.n AS VARCHAR), 5, '0') AS parent_id, a.agent_id, CASE WHEN a.sub THEN 'main' END AS parent_agent_id,
  a.type, a.ts_ms, a.n AS input_index, a.summary, a.meta_role, a.failed AS meta_tests_failed, a.file_path, a.command, a.tool_name, a.status, a.error FROM nm a LEFT JOIN nm b ON b.user_id = a.user_id AND b.call = a.answers""",
    "src_chat_replay": f"""{_CHAT},
       cl AS (SELECT *, event_type IN ('purchase', 'signup') AS impl, event_type IN ('click', 'error') AS shell, event_type = 'click' AS tested, event_type IN ('click', 'error') AND k % 4 = 0 AS bad FROM ln JOIN fs USING (user_id) WHERE NOT torn)
       SELECT 'u' || user_id AS file, 'session-' AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
         CASE WHEN impl THEN 'implementation' WHEN tested THEN 'verification' WHEN shell THEN 'other' ELSE 'observation' END AS event_type, ts_ms - started_ms AS ts_offset,
         CASE event_type WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'Write' ELSE 'Bash' END AS tool_name, CASE WHEN heard AND (impl OR shell) THEN NOT bad END AS ok,
         CASE WHEN tested THEN 'test' END AS verification_kind, CASE WHEN impl THEN 1 END AS changed_files,
         CASE event_type WHEN 'purchase' THEN {_hmac("'{\"v\":2,\"op\":\"edit\",\"parts\":[\"' || k || '\",\"' || k || 'x\"]}'")} WHEN 'signup' THEN {_hmac("'{\"v\":2,\"op\":\"write\",\"parts\":[\"c' || k || '\"]}'")} END AS change_hash,
         CASE WHEN impl THEN 'content' END AS fingerprint_basis, CASE WHEN tested AND bad AND heard THEN substr(sha256('<N> tests failed'), 1, 8) END AS failure_sig, CASE WHEN tested AND heard THEN CASE WHEN bad THEN k ELSE 0 END END AS tests_failed,
         CASE WHEN heard AND (impl OR shell) THEN CAST(k AS DOUBLE) END AS duration_ms, CASE WHEN impl THEN count(*) FILTER (impl) OVER (PARTITION BY user_id ORDER BY event_id) END AS turn, CASE WHEN impl THEN k % 3 = 0 END AS test_only,
         CASE WHEN NOT shell THEN 'src/m' || k || CASE WHEN k % 3 = 0 THEN '.test.ts' ELSE '.ts' END END AS path FROM cl""",
    "rep_corpus_survey": f"""{_CHAT},
       fa AS (SELECT 'line_type' AS facet, CASE WHEN torn THEN 'unreadable' ELSE 'assistant' END AS key FROM ln UNION ALL SELECT 'line_type', 'user' FROM ln WHERE heard
         UNION ALL SELECT 'key', 'assistant.' || unnest(['type', 'timestamp', 'sessionId', 'cwd', 'message']) FROM ln WHERE NOT torn UNION ALL SELECT 'key', 'user.' || unnest(['type', 'timestamp', 'message', 'toolUseResult']) FROM ln WHERE heard
         UNION ALL SELECT 'block_type', 'tool_use' FROM ln WHERE NOT torn UNION ALL SELECT 'block_type', 'tool_result' FROM ln WHERE heard
         UNION ALL SELECT 'tool_name', CASE event_type WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'Write' ELSE 'Bash' END FROM ln WHERE NOT torn
         UNION ALL SELECT 'first_word', CASE event_type WHEN 'click' THEN 'npm' ELSE 'ls' END FROM ln WHERE NOT torn AND event_type IN ('click', 'error')
         UNION ALL SELECT 'edit', CASE event_type WHEN 'purchase' THEN 'replace' ELSE 'whole' END FROM ln WHERE NOT torn AND event_type IN ('purchase', 'signup')
         UNION ALL SELECT 'pairing', CASE WHEN torn THEN 'unasked' WHEN heard THEN 'paired' ELSE 'unanswered' END FROM ln WHERE heard OR NOT torn
         UNION ALL SELECT 'session_files', '1' FROM (SELECT DISTINCT user_id FROM ln WHERE NOT torn))
       SELECT facet, key, count(*) AS n FROM fa GROUP BY ALL""",
    "src_chat_replay_files": f"""{_CHAT}
       SELECT 'u' || user_id AS file, CASE WHEN bool_or(NOT torn) THEN 'session-' ELSE 'session' END AS session_id, count(*) + count(*) FILTER (heard) AS lines, count(*) FILTER (NOT torn) + count(*) FILTER (heard) AS parsed_lines,
         any_value(started_ms) AS started_ms, strftime(make_timestamp(any_value(started_ms) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS started_at, any_value(last_ms) AS last_ms FROM ln LEFT JOIN fs USING (user_id) GROUP BY user_id""",
    "src_generic_events": f"WITH {bind.SESSION_EVENTS_SQL} SELECT id, session_id, agent_id, type, ts_ms, input_index, file_path, command, status, error, exit_code, meta_role, 'generic-jsonl' AS source FROM se WHERE input_index % 10 <> 7",
    "src_tolerant_warnings": f"WITH {bind.SESSION_EVENTS_SQL} SELECT session_id AS file, input_index AS line_no, 'line ' || input_index || ': invalid JSON skipped' AS warning FROM se WHERE input_index % 10 = 7",
    "src_detect_adapter": f"WITH {bind.SESSION_EVENTS_SQL}, hd AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY input_index) AS n FROM se) SELECT session_id AS file, CASE WHEN count(*) FILTER (WHERE input_index % 10 <> 7) >= greatest(1, ceil(count(*) / 2.0)) THEN 'generic-jsonl' END AS adapter FROM hd WHERE n <= 10 GROUP BY 1",
    "src_hook_events": f"WITH {bind.REPLAY_EVENTS_SQL} SELECT session_id, seq, event_type, CASE WHEN event_type = 'verification' THEN coalesce(ok, tests_failed = 0) ELSE ok END AS ok, verification_kind, change_hash, tests_failed FROM re WHERE event_type IN ('implementation', 'verification')",
    "src_device_captures": """WITH ev AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_id AS attempt_id,
       'P' || (k % 5) || '#' || substr(sha256('[button] Go ' || k || chr(10) || '[text] Hi'), 1, 8) AS screen_sig, CASE WHEN k % 3 = 0 THEN 'NullError:M' || k || '#run' END AS crash_sig, TRUE AS verified FROM ev""",
}
