"""Registered queries of rollout logs (SRC10): events written as a rollout log, and what the replay operators make of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as R
from ..operators.ordered import one_chunk
from ..runtime import spread
from ..sources import rollout_logs as P
from . import bind
from .catalog_replay import ORACLES as REPLAY
from .catalog_scalars import SECRET, _hmac
from .silver import silver


def rollout_log(s, d):
    """Events as rollout lines, one file per user; every third user never checks anything. By event type a patch call, a shell call, a program with a patch and a check, a program without
    either, or a patch in call arguments; outputs for most, a boundary before every sixth, a token counter after every third."""
    e = spread(bind.raw_events(s, d).select("event_id", "user_id", "event_type", "k", "ts_ms")).withColumn("at", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    k, kind, text, none = F.col("k"), F.col("event_type"), F.col("k").cast("string"), F.lit(None).cast("string")
    quiet = F.col("user_id") % 3 == 0
    path = F.concat(F.lit("src/m"), text, F.when(k % 3 == 0, ".test.ts").otherwise(".ts"))
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File: "), path, F.lit("\n+x"), text, F.lit("\n*** End Patch"))
    held = F.concat(F.lit("const p = `*** Begin Patch\n*** Update File: "), path, F.lit("\\n\n+y"), text, F.lit("\n*** End Patch`;\n"))
    program = F.when(kind == "purchase", F.concat(held, F.when((k % 2 == 0) & ~quiet, 'await tools.exec_command("npm run build")').otherwise("done()"))).when(kind == "signup", 'await tools.shell_command("ls")')
    name = F.when(kind == "view", "apply_patch").when(kind == "click", "shell_command").when(kind == "error", "Edit").otherwise("exec")
    command = F.when(quiet, F.array(F.lit("npm"), F.lit("install"))).when(k % 7 == 0, F.array(F.lit("adb"), F.lit("devices"))).otherwise(F.array(F.lit("npm"), F.lit("test")))
    arguments = F.when(kind == "click", F.to_json(F.struct(command.alias("command")))).when(kind == "error", F.to_json(F.struct(patch.alias("patch"))))
    call = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    custom = kind.isin("view", "purchase", "signup")

    def line(place, kind_of_line, payload):
        body = F.to_json(F.struct(F.lit(kind_of_line).alias("type"), F.col("at").alias("timestamp"), payload.alias("payload")))
        return F.struct((F.col("event_id") * 4 + place).alias("line_no"), body.alias("raw"))

    said = F.struct(
        F.when(custom, "custom_tool_call").otherwise("function_call").alias("type"), name.alias("name"), call.alias("call_id"),
        F.when(kind == "view", patch).otherwise(program).alias("input"), arguments.alias("arguments"),
    )
    words = F.when(k % 9 == 0, "windows sandbox: helper launch failed").otherwise(F.concat(F.lit("exit code: "), F.when(k % 4 == 0, "1").otherwise("0"), F.lit("\n"), text, F.lit(" tests failed")))
    heard = F.struct(
        F.when(custom, "custom_tool_call_output").otherwise("function_call_output").alias("type"), call.alias("call_id"),
        F.array(F.struct(words.alias("text"), F.lit("output_text").alias("type"))).alias("output"),
    )
    counter = F.struct(F.struct((F.col("event_id") * 3).alias("total_tokens")).alias("thread_token_usage"))
    lines = F.array(
        F.when(k % 6 == 0, line(0, "turn_context", F.struct(none.alias("id")))), line(1, "response_item", said),
        F.when(k % 5 != 0, line(2, "response_item", heard)), F.when(k % 3 == 0, line(3, "token_usage_record", counter)),
    )
    head = e.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("at", "event_id").alias("at"))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.col("at").alias("timestamp"), F.struct(F.lpad(F.col("user_id").cast("string"), 10, "0").alias("id"), F.lit("/w").alias("cwd")).alias("payload")))
    file = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file")
    body = e.select(file, F.inline(F.filter(lines, lambda x: x.isNotNull())))
    return body.union(head.select(file, F.lit(-1).cast("bigint"), meta))


def _part(i):
    def build(s, d):
        if i == 0:
            return P.codex_replay(rollout_log(s, d), SECRET)[0]
        return P.codex_replay(rollout_log(s, d), SECRET)[i]

    return build


def events(s, d):
    return silver(s, d, "rollout_events", lambda: _part(0)(s, d))


def tokens(s, d):
    return silver(s, d, "rollout_tokens", lambda: _part(1)(s, d))


def facts(s, d):
    return silver(s, d, "rollout_facts", lambda: _part(2)(s, d))


def windows(s, d):
    """One window for each file: the middle half of its time."""
    span = F.col("last_ms") - F.col("epoch_ms")
    return facts(s, d).select(F.col("file").alias("window_id"), F.col("file").alias("session_id"), (F.col("epoch_ms") + F.floor(span / 4)).alias("from_ms"), (F.col("epoch_ms") + F.floor(span * 3 / 4)).alias("to_ms"))


def window_tokens(s, d):
    return R.tokens_in_window(tokens(s, d).drop("session_id").withColumnRenamed("file", "session_id"), windows(s, d)).select("window_id", "tokens")


def segmented(s, d):
    return silver(s, d, "rollout_segmented", lambda: R.segment(events(s, d).withColumn("session_id", F.col("file")), one_chunk(events(s, d), "seq")))


def attempts(s, d):
    return silver(s, d, "rollout_attempts", lambda: R.attempts(segmented(s, d)))


def findings(s, d):
    return silver(s, d, "rollout_findings", lambda: R.findings(attempts(s, d), R.attempt_turns(segmented(s, d))))


QUERIES = {
    "src_rollout_replay": lambda s, d: events(s, d).drop("source", "duration_ms"),
    "src_rollout_tokens": tokens,
    "src_rollout_files": facts,
    "rep_rollout_window_tokens": window_tokens,
    "rep_rollout_attempts": attempts,
    "rep_rollout_verification_debt": lambda s, d: R.verification_debt(attempts(s, d), R.attempt_turns(segmented(s, d))),
    "rep_rollout_verdict": lambda s, d: R.replay_verdict(attempts(s, d), findings(s, d)),
    "rep_rollout_top_unverified": lambda s, d: R.top_unverified(findings(s, d)).select("session_id", "turns", "confidence"),
    "rep_rollout_escalate": lambda s, d: R.escalate(attempts(s, d).select("session_id").distinct().withColumn("policy", F.lit("OBSERVE")), findings(s, d)),
}

_LOG = """
WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
fs AS (SELECT user_id, arg_min(ts_ms, event_id) AS epoch_ms, max(ts_ms) AS last_ms, bool_or(k % 6 = 0) AS turn_aware, bool_or(event_type = 'click' AND k % 7 = 0 AND user_id % 3 <> 0) AS mobile FROM ev GROUP BY 1),
ln AS (SELECT *, 'src/m' || k || CASE WHEN k % 3 = 0 THEN '.test.ts' ELSE '.ts' END AS file_path, count(*) FILTER (k % 6 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS turns, k % 5 <> 0 AS heard, k % 9 = 0 AS never
       FROM ev JOIN fs USING (user_id)),
pt AS (SELECT *, '*** Begin Patch' || chr(10) || '*** Update File: ' || file_path || CASE WHEN event_type = 'purchase' THEN '\\n' || chr(10) || '+y' ELSE chr(10) || '+x' END || k || chr(10) || '*** End Patch' AS patch FROM ln),
al AS (SELECT *, 0 AS sub, 'implementation' AS kind, CAST(NULL AS VARCHAR) AS chk FROM pt WHERE event_type IN ('view', 'error', 'purchase')
       UNION ALL SELECT *, 1, 'verification', CASE WHEN event_type = 'purchase' THEN 'build' WHEN k % 7 = 0 THEN 'device' ELSE 'test' END FROM pt WHERE user_id % 3 <> 0 AND (event_type = 'click' OR (event_type = 'purchase' AND k % 2 = 0))
       UNION ALL SELECT *, 1, 'other', NULL FROM pt WHERE event_type = 'signup' OR (event_type = 'click' AND user_id % 3 = 0))"""
_JSON_PATCH = "replace(replace(patch, '\\', '\\\\'), chr(10), '\\n')"

ORACLES = {
    "src_rollout_replay": f"""{_LOG}
       SELECT 'u' || user_id AS file, substr(lpad(CAST(user_id AS VARCHAR), 10, '0'), 1, 8) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id, sub) AS seq,
         CASE WHEN kind = 'verification' AND heard AND never THEN 'other' ELSE kind END AS event_type, ts_ms - epoch_ms AS ts_offset,
         CASE WHEN kind = 'implementation' THEN 'apply_patch' WHEN event_type = 'click' THEN 'shell_command' ELSE 'exec' END AS tool_name,
         CASE WHEN kind = 'verification' AND heard AND NOT never THEN k % 4 <> 0 END AS ok, CASE WHEN NOT (heard AND never) THEN chk END AS verification_kind,
         CASE WHEN kind = 'implementation' THEN 1 END AS changed_files, CASE WHEN kind = 'implementation' THEN {_hmac("'{\"v\":2,\"op\":\"patch\",\"parts\":[\"' || " + _JSON_PATCH + " || '\"]}'")} END AS change_hash,
         CASE WHEN kind = 'implementation' THEN 'content' END AS fingerprint_basis,
         CASE WHEN kind = 'verification' AND heard AND NOT never AND k % 4 = 0 THEN substr(sha256('<N> tests failed'), 1, 8) END AS failure_sig,
         CASE WHEN kind = 'verification' AND heard AND NOT never THEN CASE WHEN k % 4 = 0 THEN k WHEN chk = 'test' THEN 0 END END AS tests_failed,
         CASE WHEN kind = 'implementation' AND turns > 0 THEN turns END AS turn, CASE WHEN kind = 'implementation' THEN k % 3 = 0 END AS test_only, CASE WHEN kind = 'implementation' THEN file_path END AS path
       FROM al""",
    "src_rollout_tokens": f"{_LOG} SELECT 'u' || user_id AS file, substr(lpad(CAST(user_id AS VARCHAR), 10, '0'), 1, 8) AS session_id, ts_ms, event_id * 4 + 3 AS record_no, event_id * 3 AS total_tokens FROM ln WHERE k % 3 = 0",
    "src_rollout_files": f"{_LOG} SELECT 'u' || user_id AS file, substr(lpad(CAST(user_id AS VARCHAR), 10, '0'), 1, 8) AS session_id, epoch_ms, last_ms, turn_aware, mobile FROM fs",
    "rep_rollout_window_tokens": f"""{_LOG},
       wn AS (SELECT user_id, epoch_ms + CAST(floor((last_ms - epoch_ms) / 4) AS BIGINT) AS a, epoch_ms + CAST(floor((last_ms - epoch_ms) * 3 / 4) AS BIGINT) AS b FROM fs),
       tk AS (SELECT user_id, ts_ms, event_id, event_id * 3 AS total FROM ln WHERE k % 3 = 0),
       xs AS (SELECT user_id, arg_max(total, (ts_ms, event_id)) FILTER (ts_ms < a) AS before, arg_max(total, (ts_ms, event_id)) FILTER (ts_ms BETWEEN a AND b) AS inside FROM wn LEFT JOIN tk USING (user_id) GROUP BY user_id)
       SELECT 'u' || user_id AS window_id, CASE WHEN inside - coalesce(before, 0) >= 0 THEN inside - coalesce(before, 0) END AS tokens FROM xs""",
}

_EVENTS = f"re AS (SELECT * EXCLUDE (session_id) RENAME (file AS session_id) FROM ({ORACLES['src_rollout_replay']}))"
ORACLES |= {f"rep_rollout_{name}": REPLAY[f"rep_{name}"].replace(bind.REPLAY_EVENTS_SQL, _EVENTS) for name in ("attempts", "verification_debt", "verdict", "top_unverified", "escalate")}
