"""Registered queries of project hook packets (SRC15): events written as hooks, one session per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.native_streams import Capture
from ..sources.project_hooks import hook_capture
from . import bind
from .catalog_native import _nid


def packets(s, d):
    """Stops, failures and tool packets by ``k``; odd users have no start, every third no end."""
    e = bind.raw_events(s, d)
    k, kind, eid, text = F.col("k"), F.col("event_type"), F.col("event_id"), F.col("k").cast("string")
    session, call = F.concat(F.lit("s"), F.col("user_id").cast("string")), F.concat(F.lit("c"), F.col("event_id").cast("string"))

    def js(event, **fields):
        return F.to_json(F.struct(session.alias("session_id"), F.lit(event).alias("hook_event_name"), *[v.alias(n) for n, v in fields.items()]))

    def tool(event, name, field, value, **more):
        return js(event, tool_use_id=call, tool_name=F.lit(name), tool_input=F.struct(value.alias(field)), **more)

    url, file, plain = F.concat(F.lit("https://x.org/"), text), F.concat(F.lit("f"), text), ~(k % 10).isin(0, 9)
    first = (
        F.when(k % 10 == 0, js("Stop", last_assistant_message=F.concat(F.lit("answer "), text))).when(k % 10 == 9, js("StopFailure"))
        .when(kind == "view", tool("PostToolUse", "WebFetch", "url", url, tool_response=F.struct(F.concat(F.lit("read "), text).alias("result"))))
        .when(kind == "click", tool("PreToolUse", "Read", "file_path", file)).when(kind == "purchase", tool("PreToolUse", "WebFetch", "url", url))
        .when(kind == "signup", tool("PreToolUse", "Bash", "query", F.lit("ls"))).when(k % 2 == 0, tool("PreToolUse", "Read", "file_path", file, agent_id=F.lit("sub")))
        .otherwise(tool("PostToolUseFailure", "WebSearch", "query", F.concat(F.lit("q"), text)))
    )
    second = F.when(plain & (kind == "click"), tool("PostToolUse", "Read", "file_path", F.lit("other"), tool_response=F.struct(F.struct(F.concat(F.lit("text "), text).alias("content")).alias("file"))))
    lines = e.select(F.inline(F.array(F.struct((eid * 2).alias("line_no"), first.alias("raw")), F.struct((eid * 2 + 1).alias("line_no"), second.alias("raw"))))).where("raw IS NOT NULL")
    users = e.select("user_id").distinct()
    starts = users.where("user_id % 2 = 0").select(F.lit(-1).cast("bigint"), js("SessionStart"))
    return lines.union(starts).union(users.where("user_id % 3 <> 0").select(F.lit(1 << 40).cast("bigint"), js("SessionEnd")))


_DONE: dict[tuple[str, str], Capture] = {}


def capture(s, d) -> Capture:
    key = (s.sparkContext.applicationId, d)
    if key not in _DONE:
        _DONE[key] = hook_capture(packets(s, d))
    return _DONE[key]


def records(s, d):
    rows = capture(s, d).records.where("record_kind <> 'run'")
    return rows.select("run_id", "turn", "record_kind", "record_id", "type", "query", "location", "source_id", "source_kind", "outcome", "summary", "answer", "answer_hash")


QUERIES = {
    "src_hook_records": records,
    "src_hook_gaps": lambda s, d: capture(s, d).gaps,
    "src_hook_runs": lambda s, d: capture(s, d).runs,
}

_TURN = "CAST(turn AS VARCHAR)"
_HOOKS = f"""
WITH ev AS (SELECT event_id, user_id, event_type AS et, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
pk AS (SELECT *, 'run-claude-hook-' || {_nid("('s' || user_id)")} AS run_id, 'c' || event_id AS id, k % 10 NOT IN (0, 9) AND et = 'error' AND k % 2 = 0 AS nested, k % 10 NOT IN (0, 9) AS plain FROM ev),
kd AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'C' WHEN k % 10 = 9 THEN 'F' WHEN NOT nested THEN 'T' END AS kind FROM pk),
wk AS (SELECT *, last_value(CASE WHEN kind IN ('T', 'F') THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worked FROM kd),
mk AS (SELECT *, CASE WHEN kind IN ('T', 'F') THEN kind WHEN kind = 'C' AND worked IS DISTINCT FROM 'F' THEN 'S' END AS mark FROM wk),
bf AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mk),
op AS (SELECT *, CASE WHEN (mark = 'T' AND before IN ('S', 'F')) OR (mark = 'S' AND before = 'S') THEN 1 ELSE 0 END AS opens FROM bf),
tn AS (SELECT *, 1 + CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS turn, count(*) FILTER (kind = 'C') OVER (PARTITION BY user_id ORDER BY event_id) - CASE WHEN kind = 'C' THEN 1 ELSE 0 END AS stops FROM op),
oc AS (SELECT DISTINCT run_id, turn, stops FROM tn WHERE plain AND et = 'purchase'),
la AS (SELECT run_id, user_id, arg_max(mark, event_id) FILTER (mark IS NOT NULL) AS before, max(turn) AS turn, count(*) FILTER (kind = 'C') AS stops FROM tn GROUP BY ALL),
lo AS (SELECT *, {_nid('run_id', _TURN)} AS local, 'answer ' || k AS answer FROM tn WHERE mark = 'S'),
cl AS (SELECT *, CASE et WHEN 'view' THEN 'https://x.org/' || k WHEN 'click' THEN 'f' || k END AS location FROM tn WHERE plain AND (et IN ('view', 'click') OR (et = 'error' AND k % 2 = 1))),
rc AS (SELECT run_id, turn, 'event' AS record_kind, 'native-' || {_nid('run_id', _TURN, 'id')} AS record_id, CASE et WHEN 'error' THEN 'SEARCH' ELSE 'READ' END AS type, CASE et WHEN 'error' THEN 'q' || k END AS query, location,
         'source-' || {_nid("coalesce(location, 'claude-code:' || id)")} AS source_id, CASE et WHEN 'view' THEN 'URL' WHEN 'click' THEN 'FILE' ELSE 'TOOL_RESULT' END AS source_kind, CASE et WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS outcome,
         CASE et WHEN 'view' THEN 'read ' || k WHEN 'click' THEN 'text ' || k END AS summary, NULL AS answer, NULL AS answer_hash FROM cl
       UNION ALL SELECT run_id, turn, 'event', 'claim-' || local, 'CLAIM', NULL, NULL, 'answer-' || local, 'UNKNOWN', NULL, NULL, answer, NULL FROM lo
       UNION ALL SELECT run_id, turn, 'answer', 'receipt-' || local, NULL, NULL, NULL, NULL, NULL, NULL, NULL, answer, sha256(answer) FROM lo)"""

ORACLES = {
    "src_hook_records": f"{_HOOKS} SELECT * FROM rc",
    "src_hook_runs": f"{_HOOKS} SELECT run_id, CASE WHEN user_id % 3 = 0 THEN 'RUNNING' WHEN before = 'F' THEN 'FAILED' WHEN before = 'S' THEN 'COMPLETED' ELSE 'CANCELLED' END AS lifecycle FROM la",
    "src_hook_gaps": f"""{_HOOKS},
       gp AS (SELECT run_id, 'BOUNDARY' AS code FROM la WHERE user_id % 2 = 1 UNION ALL SELECT run_id, 'BOUNDARY' FROM tn WHERE kind = 'C' AND mark IS NULL
         UNION ALL SELECT run_id, 'BOUNDARY' FROM la WHERE user_id % 3 <> 0 AND (before IS DISTINCT FROM 'S' OR EXISTS (SELECT 1 FROM oc WHERE oc.run_id = la.run_id AND oc.turn = la.turn AND oc.stops = la.stops))
         UNION ALL SELECT run_id, 'NESTED' FROM tn WHERE nested UNION ALL SELECT run_id, 'FAILED' FROM tn WHERE kind = 'F' UNION ALL SELECT run_id, 'UNKNOWN_TOOL' FROM tn WHERE plain AND et = 'signup'
         UNION ALL SELECT tn.run_id, 'MISSING_RESULT' FROM tn JOIN oc ON oc.run_id = tn.run_id AND oc.turn = tn.turn - opens AND oc.stops = tn.stops WHERE kind = 'C')
       SELECT DISTINCT run_id, 'NATIVE_' || code AS code FROM gp""",
}
