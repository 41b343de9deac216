"""Registered queries of native agent streams (SRC11): events written as packets, one run per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.native_streams import Capture, native_capture
from . import bind


def packets(s, d):
    """Users with an even number give a chat-style stream, the others an item stream; starts, ends and odd packets follow from ``k``."""
    e = bind.raw_events(s, d)
    k, kind, eid, text = F.col("k"), F.col("event_type"), F.col("event_id"), F.col("k").cast("string")
    claude, tens = F.col("user_id") % 2 == 0, F.col("k") % 10

    def js(**fields):
        return F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))

    def named(prefix):
        return F.concat(F.lit(prefix), eid.cast("string"))

    def call(name, **given):
        block = F.struct(F.lit("tool_use").alias("type"), named("c").alias("id"), F.lit(name).alias("name"), F.struct(*[v.alias(n) for n, v in given.items()]).alias("input"))
        return F.struct(F.array(block).alias("content"))

    def result(prefix, content, bad):
        block = F.struct(F.lit("tool_result").alias("type"), named(prefix).alias("tool_use_id"), content.alias("content"), bad.alias("is_error"))
        return js(type=F.lit("user"), message=F.struct(F.array(block).alias("content")))

    assistant, no = F.lit("assistant"), F.lit(False)
    talk = (
        F.when(tens == 0, js(type=F.lit("system"), subtype=F.lit("init"), session_id=F.lit("S"), claude_code_version=F.when(k == 50, "9").otherwise("2.1.121")))
        .when(tens == 9, js(type=F.lit("result"), subtype=F.lit("success"), is_error=k == 99, session_id=F.lit("S"), uuid=named("u"), result=F.concat(F.lit("answer "), text)))
        .when(tens == 8, js(type=F.lit("system"), subtype=F.lit("x")))
        .when(kind == "view", js(type=assistant, message=call("Read", file_path=F.concat(F.lit("f"), text))))
        .when(kind == "click", js(type=assistant, message=call("WebSearch", query=F.concat(F.lit("q"), text))))
        .when(kind == "purchase", result("o", F.lit("x"), no))
        .when((kind == "signup") & (k % 3 == 0), js(type=assistant, message=call("Bash", command=F.lit("ls"))))
        .when(kind == "signup", js(type=assistant, parent_tool_use_id=F.lit("p"), message=call("Read", file_path=F.lit("f"))))
        .when(k % 3 == 0, "[]").otherwise(js(type=assistant, message=F.struct(F.array(F.struct(F.lit("text").alias("type"))).alias("content"))))
    )
    plain = ~tens.isin(0, 8, 9)
    heard = F.when(plain & (kind == "view") & (k % 4 != 1), result("c", F.concat(F.lit("read "), text), k % 4 == 2)).when(
        plain & (kind == "click"), result("c", F.concat(F.lit('Links: [{"url":"https://x.org/'), text, F.lit('"}]')), no))
    hit = F.array(F.struct(F.concat(F.lit("https://x.org/"), text).alias("url"), F.when(k % 4 == 2, "Internal Error").otherwise("t").alias("title"), F.concat(F.lit("s"), text).alias("snippet")))

    def item(when, **fields):
        return js(type=F.lit(when), item=F.struct(*[v.alias(n) for n, v in fields.items()]))

    def action(what, name, value):
        return F.struct(F.lit(what).alias("type"), value.alias(name))

    web, url = F.lit("web_search"), F.concat(F.lit("https://y.org/"), text)
    items = (
        F.when(tens == 0, js(type=F.lit("turn.started"))).when(tens == 9, js(type=F.lit("turn.completed")))
        .when(kind == "view", item("item.completed", id=named("c"), type=web, action=action("search", "query", F.concat(F.lit("q"), text)), results=hit))
        .when(kind == "click", item("item.completed", id=named("m"), type=F.lit("agent_message"), text=F.concat(F.lit("answer "), text)))
        .when(kind == "purchase", item("item.started", id=named("p"), type=web))
        .when(kind == "signup", item("item.completed", id=named("c"), type=web, action=action("open_page", "url", url)))
        .when((k == 33) & (F.col("user_id") % 4 == 1), js(type=F.lit("error"))).otherwise(item("item.completed", id=named("r"), type=F.lit("reasoning")))
    )
    lines = F.array(F.struct((eid * 2).alias("line_no"), F.when(claude, talk).otherwise(items).alias("raw")), F.struct((eid * 2 + 1).alias("line_no"), F.when(claude, heard).alias("raw")))
    return e.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.when(claude, "claude-code").otherwise("codex").alias("adapter"), F.when(~claude, "0.160.1").alias("agent_version"), F.inline(lines)
    ).where("raw IS NOT NULL")


_DONE: dict[tuple[str, str], Capture] = {}


def capture(s, d) -> Capture:
    key = (s.sparkContext.applicationId, d)
    if key not in _DONE:
        _DONE[key] = native_capture(packets(s, d))
    return _DONE[key]


def records(s, d):
    rows = capture(s, d).records.where("record_kind <> 'run'")
    return rows.select("run_id", "turn", "record_kind", "record_id", "type", "query", "location", "source_id", "source_kind", "outcome", "summary", F.when(F.col("results").isNotNull(), F.size("results")).alias("results"),
                       "tool_result_id", "answer", "answer_hash", "scope_declared")


QUERIES = {
    "src_native_records": records,
    "src_native_gaps": lambda s, d: capture(s, d).gaps,
    "src_native_scope": lambda s, d: capture(s, d).scope.select("run_id", "receipt_id", "event_id"),
    "src_native_runs": lambda s, d: capture(s, d).runs,
}


def _nid(*parts):
    return "substr(sha256('[' || " + " || ',' || ".join(f"'\"' || {p} || '\"'" for p in parts) + " || ']'), 1, 40)"


_TEXT_TURN = "CAST(turn AS VARCHAR)"
_PACKETS = f"""
WITH ev AS (SELECT event_id, user_id, event_type AS et, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id % 2 = 0 AS claude, 'r' || user_id AS run_id FROM events),
pk AS (SELECT *, k % 10 = 0 AS begins, k % 10 = 9 AS ends, NOT claude AND k % 10 NOT IN (0, 9) AND et = 'error' AND k = 33 AND user_id % 4 = 1 AS breaks, k % 10 NOT IN (0, 9) AND (NOT claude OR k % 10 <> 8) AS plain,
       claude AND k % 10 NOT IN (0, 8, 9) AND et = 'error' AND k % 3 = 0 AS malformed FROM ev),
tn AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM pk WHERE NOT malformed),
t1 AS (SELECT run_id, turn, min(event_id) FILTER (ends) AS fin, min(event_id) FILTER (breaks) AS broken FROM tn GROUP BY ALL),
fa AS (SELECT run_id, min(broken) AS failed_at FROM t1 WHERE broken IS NOT NULL AND (fin IS NULL OR broken < fin) GROUP BY 1),
t2 AS (SELECT run_id, turn, CASE WHEN failed_at IS NULL OR fin < failed_at THEN fin END AS fin, max(turn) OVER (PARTITION BY run_id) AS last_turn FROM t1 LEFT JOIN fa USING (run_id)),
al AS (SELECT tn.*, fin, last_turn, coalesce(event_id > fin, FALSE) AS late FROM tn JOIN t2 USING (run_id, turn)),
lv AS (SELECT *, 'c' || event_id AS id FROM al WHERE NOT late),
cd AS (SELECT run_id, turn, max(event_id) AS said_at, arg_max(k, event_id) AS said_k FROM lv WHERE NOT claude AND plain AND et = 'click' GROUP BY ALL),
nd AS (SELECT a.*, said_at, said_k, claude AND k = 99 AS bad FROM al a LEFT JOIN cd USING (run_id, turn) WHERE event_id = fin),
fn AS (SELECT *, CASE WHEN claude THEN 'u' || event_id ELSE 'm' || said_at END AS own, 'answer ' || CASE WHEN claude THEN k ELSE said_k END AS answer FROM nd WHERE NOT bad AND (claude OR said_at IS NOT NULL)),
lo AS (SELECT *, {_nid('run_id', _TEXT_TURN, 'own')} AS local FROM fn),
cl AS (SELECT *, CASE WHEN claude THEN et = 'click' ELSE et = 'view' END AS search, CASE WHEN claude AND et = 'view' THEN 'f' || k WHEN NOT claude AND et = 'signup' THEN 'https://y.org/' || k END AS location,
       CASE WHEN claude THEN et = 'view' AND k % 4 = 1 ELSE et = 'signup' END AS missing, k % 4 = 2 AND et = 'view' AS failed FROM lv WHERE plain AND ((claude AND et IN ('view', 'click')) OR (NOT claude AND et IN ('view', 'signup')))),
rc AS (SELECT run_id, turn, 'event' AS record_kind, 'native-' || {_nid('run_id', _TEXT_TURN, 'id')} AS record_id, CASE WHEN search THEN 'SEARCH' ELSE 'READ' END AS type, CASE WHEN search THEN 'q' || k END AS query, location,
         'source-' || {_nid("coalesce(location, CASE WHEN claude THEN 'claude-code:' ELSE 'codex:' END || id)")} AS source_id, CASE WHEN location IS NULL THEN 'TOOL_RESULT' WHEN claude THEN 'FILE' ELSE 'URL' END AS source_kind,
         CASE WHEN missing THEN 'UNKNOWN' WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS outcome, CASE WHEN NOT search AND NOT missing THEN 'read ' || k END AS summary,
         CASE WHEN search THEN CASE WHEN failed THEN 0 ELSE 1 END END AS results, CASE WHEN NOT missing THEN id END AS tool_result_id, NULL AS answer, NULL AS answer_hash, NULL AS scope_declared FROM cl
       UNION ALL SELECT run_id, turn, 'event', 'claim-' || local, 'CLAIM', NULL, NULL, 'answer-' || {_nid('own')}, 'UNKNOWN', NULL, NULL, NULL, NULL, answer, NULL, NULL FROM lo
       UNION ALL SELECT run_id, turn, 'answer', 'receipt-' || local, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, answer, sha256(answer), turn > 0 FROM lo)"""

ORACLES = {
    "src_native_records": f"{_PACKETS} SELECT * FROM rc",
    "src_native_scope": f"{_PACKETS} SELECT a.run_id, a.record_id AS receipt_id, b.record_id AS event_id FROM rc a JOIN rc b USING (run_id, turn) WHERE a.record_kind = 'answer' AND b.record_kind = 'event' AND turn > 0",
    "src_native_runs": f"""{_PACKETS} SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM nd WHERE bad UNION SELECT run_id FROM lv WHERE breaks) THEN 'FAILED' WHEN max(fin) FILTER (turn = last_turn) IS NOT NULL THEN 'COMPLETED' ELSE 'UNKNOWN' END AS lifecycle
       FROM t2 GROUP BY run_id""",
    "src_native_gaps": f"""{_PACKETS},
       gp AS (SELECT run_id, 'MALFORMED' AS code FROM pk WHERE malformed UNION ALL SELECT run_id, 'DRIFT' FROM lv WHERE claude AND ((begins AND k = 50) OR k % 10 = 8)
         UNION ALL SELECT run_id, 'BOUNDARY' FROM al WHERE late UNION ALL SELECT run_id, 'BOUNDARY' FROM t2 WHERE fin IS NULL AND (turn > 0 OR turn = last_turn)
         UNION ALL SELECT run_id, 'BOUNDARY' FROM lv WHERE NOT claude AND ends AND event_id IS DISTINCT FROM fin UNION ALL SELECT run_id, 'BOUNDARY' FROM nd WHERE NOT claude AND said_at IS NULL
         UNION ALL SELECT run_id, 'NESTED' FROM lv WHERE claude AND plain AND et = 'signup' AND k % 3 <> 0 UNION ALL SELECT run_id, 'UNKNOWN_TOOL' FROM lv WHERE claude AND plain AND et = 'signup' AND k % 3 = 0
         UNION ALL SELECT run_id, 'FAILED' FROM nd WHERE bad UNION ALL SELECT run_id, 'FAILED' FROM lv WHERE breaks
         UNION ALL SELECT run_id, 'MISSING_RESULT' FROM cl WHERE missing UNION ALL SELECT run_id, 'MISSING_RESULT' FROM lv WHERE NOT claude AND plain AND et = 'purchase' AND turn = last_turn
         UNION ALL SELECT run_id, 'ORPHAN_RESULT' FROM lv WHERE claude AND plain AND et = 'purchase')
       SELECT DISTINCT run_id, 'NATIVE_' || code AS code FROM gp""",
}
