"""Registered session queries (SES) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import problems as P
from ..functions.text import first_line
from ..operators import problems as Pr, sessions as S
from . import bind
from .silver import silver

LIVE_MS = 21_600_000


def events(spark: SparkSession, d: str) -> DataFrame:
    return silver(spark, d, "session_events", lambda: bind.session_events(spark, d))


def lifecycle(spark, d):
    """Lifecycle with liveness: the last event time stands for the file's modification time."""
    def build():
        base = S.session_lifecycle(events(spark, d))
        files = base.select("session_id", F.col("last_ms").alias("modified_ms"))
        now = events(spark, d).agg(F.max("ts_ms")).first()[0]
        return S.liveness(files, base, now, LIVE_MS).where("running")

    live = silver(spark, d, "session_live", build)
    return S.session_lifecycle(events(spark, d), live), live


def graph(spark, d):
    return silver(spark, d, "agent_graph", lambda: S.agent_graph(events(spark, d)))


def families(spark, d):
    return silver(spark, d, "agent_families", lambda: S.agent_families(events(spark, d)))


def problems(spark, d):
    def build():
        ev = events(spark, d)
        return Pr.detect_problems(ev, families(spark, d), graph(spark, d), lifecycle(spark, d)[1])

    return silver(spark, d, "problems", build)


def outcome(spark, d):
    ev = events(spark, d)
    return silver(
        spark, d, "session_outcome",
        lambda: S.session_outcome(ev, lifecycle(spark, d)[0], problems(spark, d), graph(spark, d)),
    )


def spans(spark, d):
    return Pr.follow_up_spans(events(spark, d), families(spark, d), problems(spark, d))


def steps(spark, d):
    return silver(spark, d, "follow_ups", lambda: Pr.follow_ups(*spans(spark, d)))


def listing(spark, d):
    ev = events(spark, d)
    return S.session_list(
        outcome(spark, d), S.session_task(ev), S.attention(problems(spark, d), outcome(spark, d)),
        S.last_observed(ev), S.coding_sessions(ev),
    )


def ses_index(spark, d):
    return S.index_events(events(spark, d)).select("id", "session_id", "position", "offset_ms", "type")


def ses_lifecycle(spark, d):
    return lifecycle(spark, d)[0].drop("events")


def ses_failures(spark, d):
    """Every failing event with kind, category and description (FN11, FN12, FN13)."""
    kind = P.problem_kind()
    return (
        events(spark, d)
        .where(P.is_failure())
        .withColumn("kind", kind)
        .withColumn("identity", first_line(F.col("error")))
        .withColumn("cls", P.classify_problem(F.col("kind"), F.col("identity")))
        .select("id", "kind", "identity", F.col("cls.category").alias("category"), F.col("cls.detail").alias("detail"),
                P.failure_description().alias("description"))
    )


def ses_detect(spark, d):
    return problems(spark, d).select("session_id", "event_id", "kind", "category", "provider_detail", "attempts", "description")


def ses_signals(spark, d):
    return problems(spark, d).where("signal_event_id is not null").select("event_id", "signal_event_id", "signal_ms", "signal_description")


def ses_status(spark, d):
    return problems(spark, d).select("event_id", "status", "alone")


def ses_numbered(spark, d):
    return Pr.number_problems(problems(spark, d)).select("session_id", "event_id", "problem_no")


def ses_follow_ups(spark, d):
    return steps(spark, d)


def ses_files(spark, d):
    ev = events(spark, d)
    return Pr.file_involvement(S.file_touches(ev), *spans(spark, d))


def ses_root(spark, d):
    return S.settle_root(graph(spark, d), S.root_agent(events(spark, d)), outcome(spark, d)).select("session_id", "agent_id", "status")


def ses_problems_only(spark, d):
    return Pr.problems_only(events(spark, d), problems(spark, d), steps(spark, d)).select("session_id", "id")


def ses_hidden(spark, d):
    kept = ses_problems_only(spark, d).groupBy("session_id").agg(F.count("*").alias("kept"))
    total = events(spark, d).groupBy("session_id").agg(F.count("*").alias("total"))
    return total.join(kept, "session_id", "left").select(
        "session_id", (F.col("total") - F.coalesce("kept", F.lit(0))).alias("hidden")
    )


def flagship(spark, d):
    """Per session: problems by status with attempts."""
    return (
        problems(spark, d)
        .groupBy("session_id", "kind", "status")
        .agg(F.count("*").alias("problems"), F.sum("attempts").alias("attempts"))
    )


def _now(spark, d):
    return events(spark, d).agg(F.max("ts_ms")).first()[0]


def ses_days(spark, d):
    now = _now(spark, d)
    return S.day_groups(listing(spark, d), now - now % S.DAY_MS).groupBy("heading").agg(F.count("*").alias("sessions"))


QUERIES = {
    "ses_index_events": ses_index,
    "ses_lifecycle": ses_lifecycle,
    "ses_task": lambda s, d: S.session_task(events(s, d)),
    "ses_agent_graph": lambda s, d: S.agent_graph(events(s, d)),
    "ses_agent_items": lambda s, d: S.agent_items(events(s, d)),
    "ses_agent_children": lambda s, d: S.agent_children(events(s, d)),
    "ses_root_agent": ses_root,
    "ses_agent_families": lambda s, d: families(s, d),
    "ses_file_touches": lambda s, d: S.file_touches(events(s, d)),
    "ses_file_agents": lambda s, d: S.file_agents(events(s, d)),
    "ses_failures": ses_failures,
    "ses_detect_problems": ses_detect,
    "ses_recovery_signals": ses_signals,
    "ses_problem_status": ses_status,
    "ses_problem_numbers": ses_numbered,
    "ses_follow_ups": ses_follow_ups,
    "ses_file_involvement": lambda s, d: ses_files(s, d).select("session_id", "path", "involved_in_problems"),
    "ses_outcome": lambda s, d: outcome(s, d).select(
        "session_id", "outcome", "files_changed", "tests_passed", "tests_failed", "builds_passed", "builds_failed",
        "commands_run", "commands_failed", "failures", "recovered", "unresolved", "blocked", "agents"),
    "ses_problems_only": ses_problems_only,
    "ses_hidden_count": ses_hidden,
    "ses_coding": lambda s, d: S.coding_sessions(events(s, d)),
    "ses_attention": lambda s, d: S.attention(problems(s, d), outcome(s, d)),
    "ses_attention_order": lambda s, d: S.attention(problems(s, d), outcome(s, d)).join(outcome(s, d).select("session_id", "last_ms"), "session_id").select(
        "session_id", S.attention_sort_key(F.col("tier"), F.col("last_ms"), _now(s, d)).alias("sort_key")),
    "ses_radar": lambda s, d: S.radar(listing(s, d)).select("session_id", "section", "tier", "last_ms"),
    "ses_last_observed": lambda s, d: S.last_observed(events(s, d)),
    "ses_liveness": lambda s, d: S.liveness(
        ses_lifecycle(s, d).select("session_id", F.col("last_ms").alias("modified_ms")), ses_lifecycle(s, d), _now(s, d), LIVE_MS),
    "ses_list": lambda s, d: listing(s, d).drop("last_observed"),
    "ses_list_filter": lambda s, d: S.filter_list(listing(s, d), "problems", "MESSAGE 2").select("session_id", "label", "problems"),
    "ses_day_groups": ses_days,
    "ses_progress_steps": lambda s, d: S.progress_steps(S.session_task(events(s, d)), problems(s, d), S.agent_graph(events(s, d)), outcome(s, d)).drop("at_index"),
    "ses_problem_summary": flagship,
}

_FAIL = """
fl AS (SELECT *, coalesce(CASE WHEN type IN ('TEST_FAILED','BUILD_FAILED','ERROR') THEN TRUE
   WHEN type = 'COMMAND_COMPLETED' THEN coalesce(exit_code <> 0, FALSE) OR coalesce(status IN ('error','timeout','aborted'), FALSE)
   WHEN type = 'TOOL_RESULT' THEN status = 'error'
   WHEN type IN ('AGENT_COMPLETED','SUBAGENT_COMPLETED') THEN status IN ('error','aborted','timeout') END, FALSE) AS failure,
   coalesce(type = 'COMMAND_COMPLETED' AND (coalesce(exit_code = 0, FALSE) OR coalesce(status = 'ok', FALSE)), FALSE) AS ok,
   coalesce(agent_id, 'main') AS ag,
   nullif(regexp_replace(regexp_extract(replace(error, '\\', '/'), '(\\S[^\\n]*)', 1), '\\s+$', ''), '') AS identity FROM se),
fk AS (SELECT *, CASE type WHEN 'TEST_FAILED' THEN 'test-failure' WHEN 'BUILD_FAILED' THEN 'build-failure'
   WHEN 'COMMAND_COMPLETED' THEN CASE status WHEN 'timeout' THEN 'timeout' WHEN 'aborted' THEN 'abort' ELSE 'command-failure' END
   WHEN 'AGENT_COMPLETED' THEN 'agent-failure' WHEN 'SUBAGENT_COMPLETED' THEN 'agent-failure' ELSE 'error' END AS kind FROM fl),
fd AS (SELECT *, CASE WHEN kind NOT IN ('error','agent-failure') THEN NULL
      WHEN regexp_matches(coalesce(identity,''), '(?i)\\b402\\b|quota\\s*(exceeded|exhausted)|insufficient_quota|credit.{0,20}(exceeded| exhausted)|billing') THEN 'QUOTA'
      WHEN regexp_matches(coalesce(identity,''), '(?i)\\b40[13]\\b|unauthorized|forbidden|invalid[_\\s]api[_\\s]?key|authentication') THEN 'AUTH'
      WHEN regexp_matches(coalesce(identity,''), '(?i)\\b429\\b|rate[_\\s]?limit|too\\s+many\\s+requests') THEN 'RATE_LIMIT' END AS detail FROM fk),
fc AS (SELECT *, CASE WHEN kind IN ('test-failure','build-failure') THEN 'VALIDATION' WHEN kind IN ('command-failure','timeout','abort') THEN 'TOOL'
      WHEN detail IS NOT NULL THEN 'PROVIDER'
      WHEN regexp_matches(coalesce(identity,''), '(?i)timeout|timed\\s*out|ECONNRESET|ECONNREFUSED|ENOTFOUND|EPIPE|socket\\s+hang\\s+up|network\\s+(error|unreachable)|DNS') THEN 'ENVIRONMENT'
      WHEN regexp_matches(coalesce(identity,''), '(?i)\\bAPI\\b|overloaded|internal\\s+server\\s+error|\\b5\\d\\d\\b') THEN 'PROVIDER'
      WHEN kind = 'agent-failure' THEN 'UNKNOWN' ELSE 'CODE' END AS category FROM fd),
ff AS (SELECT *, failure AND category IN ('PROVIDER','ENVIRONMENT') AS external,
   CASE type
    WHEN 'TEST_FAILED' THEN coalesce(command,'test run') || ' — ' || CASE WHEN meta_tests_failed IS NOT NULL THEN CAST(CAST(meta_tests_failed AS BIGINT) AS VARCHAR) || ' test' || CASE WHEN meta_tests_failed = 1 THEN '' ELSE 's' END || ' failed' ELSE 'tests failed' END
    WHEN 'BUILD_FAILED' THEN coalesce(command, tool_name, 'build') || ' — build failed'
    WHEN 'COMMAND_COMPLETED' THEN coalesce(command, tool_name, 'command') || ' failed' || coalesce(' (exit code ' || CAST(exit_code AS VARCHAR) || ')', '')
    WHEN 'AGENT_COMPLETED' THEN agent_id || ' failed' WHEN 'SUBAGENT_COMPLETED' THEN agent_id || ' failed'
    WHEN 'TOOL_RESULT' THEN coalesce(tool_name, 'tool') || ' call reported an error'
    ELSE coalesce(coalesce(command, tool_name, file_path) || ' — error', 'error reported') END AS fdesc FROM fc)"""

_AGENTS = """
st AS (SELECT session_id, agent_id, coalesce(parent_agent_id, 'main') AS parent, ts_ms, input_index FROM se
   WHERE type IN ('AGENT_STARTED','SUBAGENT_STARTED') AND agent_id <> coalesce(parent_agent_id, 'main')),
seen AS (SELECT session_id, coalesce(agent_id,'main') AS agent_id,
   arg_max(CASE WHEN type IN ('AGENT_STARTED','SUBAGENT_STARTED') THEN 'RUNNING' WHEN status IN ('error','aborted','timeout') THEN 'FAILED'
      WHEN status = 'ok' OR meta_outcome = 'success' THEN 'SUCCESS' ELSE 'UNKNOWN' END, (ts_ms, input_index))
      FILTER (WHERE type IN ('AGENT_STARTED','SUBAGENT_STARTED','AGENT_COMPLETED','SUBAGENT_COMPLETED')) AS status,
   arg_min(CASE WHEN type = 'MESSAGE' THEN CASE WHEN length(summary) > 120 THEN substr(summary,1,119) || '…' ELSE summary END ELSE meta_task END, (ts_ms, input_index))
      FILTER (WHERE (type = 'MESSAGE' AND summary IS NOT NULL) OR (type IN ('AGENT_STARTED','SUBAGENT_STARTED') AND meta_task IS NOT NULL)) AS task_summary,
   min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms, count(*) AS event_count FROM se GROUP BY 1, 2),
par AS (SELECT session_id, agent_id, arg_max(parent, (ts_ms, input_index)) AS parent_agent_id FROM st GROUP BY 1, 2),
nodes AS (SELECT session_id, agent_id FROM seen UNION SELECT session_id, parent FROM st),
ag AS (SELECT n.session_id, n.agent_id, p.parent_agent_id, coalesce(s.status, 'UNKNOWN') AS status, s.task_summary, s.started_ms, s.ended_ms,
   greatest(0, s.ended_ms - s.started_ms) AS duration_ms, coalesce(s.event_count, 0) AS event_count
   FROM nodes n LEFT JOIN seen s USING (session_id, agent_id) LEFT JOIN par p USING (session_id, agent_id))"""

# Families: everything reachable over parent links in both directions; labelled like the operator does.
_FAMILY = """
und AS (SELECT session_id, agent_id AS a, parent_agent_id AS b FROM par UNION SELECT session_id, parent_agent_id, agent_id FROM par),
reach AS (SELECT session_id, a AS src, a AS dst FROM und UNION SELECT r.session_id, r.src, u.b FROM reach r JOIN und u ON u.session_id = r.session_id AND u.a = r.dst),
loose AS (SELECT DISTINCT p.session_id, p.parent_agent_id AS agent_id FROM par p WHERE NOT EXISTS (SELECT 1 FROM par q WHERE q.session_id = p.session_id AND q.agent_id = p.parent_agent_id)),
climb AS (SELECT session_id, agent_id AS src, parent_agent_id AS up FROM par UNION SELECT c.session_id, c.src, p.parent_agent_id FROM climb c JOIN par p ON p.session_id = c.session_id AND p.agent_id = c.up),
cyc AS (SELECT session_id, src AS agent_id FROM climb WHERE src = up),
fam AS (SELECT r.session_id, r.src AS agent_id,
   coalesce(min(l.agent_id), min(c.agent_id)) AS family
   FROM reach r LEFT JOIN loose l ON l.session_id = r.session_id AND l.agent_id = r.dst LEFT JOIN cyc c ON c.session_id = r.session_id AND c.agent_id = r.dst GROUP BY 1, 2)"""

_LIFE = f"""
lc0 AS (SELECT session_id, coalesce(arg_min(source, (ts_ms, input_index)), 'unknown') AS source,
   arg_min(list_last(string_split(meta_cwd, '/')), (ts_ms, input_index)) FILTER (WHERE type = 'SESSION_STARTED' AND meta_cwd IS NOT NULL) AS project,
   bool_or(type = 'SESSION_COMPLETED') AS done, min(ts_ms) AS started_ms,
   coalesce(max(ts_ms) FILTER (WHERE type = 'SESSION_COMPLETED'), max(ts_ms)) AS ended_ms, max(ts_ms) AS last_ms,
   arg_max(coalesce(meta_outcome, meta_status), (ts_ms, input_index)) FILTER (WHERE type = 'SESSION_COMPLETED' AND coalesce(meta_outcome, meta_status) IS NOT NULL) AS declared_outcome
   FROM se GROUP BY 1),
lc AS (SELECT session_id, source, project,
   CASE WHEN done THEN 'COMPLETED' WHEN (SELECT max(ts_ms) FROM se) - last_ms <= {LIVE_MS} THEN 'RUNNING' ELSE 'UNKNOWN' END AS session_status,
   NOT done AND (SELECT max(ts_ms) FROM se) - last_ms <= {LIVE_MS} AS running,
   started_ms, ended_ms, greatest(0, ended_ms - started_ms) AS duration_ms, last_ms, declared_outcome FROM lc0)"""

# Problems: the pair of each failure with its first closing row, then the chain of openers per group.
_PROBLEMS = """
ffm AS (SELECT f.*, coalesce(m.family, f.ag) AS family FROM ff f LEFT JOIN fam m ON m.session_id = f.session_id AND m.agent_id = f.ag),
task AS (SELECT session_id, agent_id AS ag, task_summary AS failed_task FROM seen),
fails AS (SELECT f.*, CASE WHEN kind = 'command-failure' THEN coalesce(command, chr(1)) ELSE '' END AS cmd, t.failed_task
   FROM ffm f LEFT JOIN task t USING (session_id, ag) WHERE failure),
sig AS (SELECT f.session_id, f.family, f.kind, f.cmd, f.id, f.input_index, f.ts_ms,
   min((c.ts_ms, c.input_index)) AS endpos
   FROM fails f JOIN ffm c ON c.session_id = f.session_id AND c.family = f.family AND (c.ts_ms, c.input_index) > (f.ts_ms, f.input_index)
    AND NOT (c.failure AND c.kind = f.kind AND (f.kind <> 'command-failure' OR coalesce(c.command, chr(1)) = f.cmd))
    AND (c.type = 'SESSION_COMPLETED'
      OR (f.type = 'TEST_FAILED' AND c.type = 'TEST_PASSED') OR (f.type = 'BUILD_FAILED' AND c.type = 'BUILD_PASSED')
      OR (f.type = 'COMMAND_COMPLETED' AND c.ok AND c.command = f.command)
      OR (f.kind = 'error' AND (c.type IN ('TEST_PASSED','BUILD_PASSED') OR c.ok))
      OR (f.kind = 'agent-failure' AND c.type IN ('AGENT_STARTED','SUBAGENT_STARTED') AND c.meta_task = f.failed_task))
   GROUP BY ALL),
fz AS (SELECT f.*, s.endpos FROM fails f LEFT JOIN sig s USING (session_id, family, kind, cmd, id)),
first_open AS (SELECT session_id, family, kind, cmd, min((ts_ms, input_index)) AS pos FROM fz WHERE NOT external GROUP BY ALL),
nxt AS (SELECT a.session_id, a.family, a.kind, a.cmd, (a.ts_ms, a.input_index) AS pos, min((b.ts_ms, b.input_index)) AS nextpos
   FROM fz a JOIN fz b USING (session_id, family, kind, cmd) WHERE NOT a.external AND NOT b.external AND (b.ts_ms, b.input_index) > a.endpos GROUP BY ALL),
chain AS (SELECT * FROM first_open UNION SELECT n.session_id, n.family, n.kind, n.cmd, n.nextpos FROM chain c JOIN nxt n USING (session_id, family, kind, cmd, pos)),
opn AS (SELECT f.*, c.pos FROM fz f JOIN chain c ON c.session_id = f.session_id AND c.family = f.family AND c.kind = f.kind AND c.cmd = f.cmd AND c.pos = (f.ts_ms, f.input_index)),
absorbed AS (SELECT o.id AS opener, f.id FROM opn o JOIN fz f ON f.session_id = o.session_id AND f.family = o.family AND f.kind = o.kind AND f.cmd = o.cmd
   AND (f.ts_ms, f.input_index) >= o.pos AND (o.endpos IS NULL OR (f.ts_ms, f.input_index) < o.endpos)),
att AS (SELECT opener, count(*) AS attempts FROM absorbed GROUP BY 1),
sigrow AS (SELECT o.id AS opener, c.id AS sid, c.ts_ms AS sms, c.type AS stype,
    CASE c.type WHEN 'TEST_PASSED' THEN 'tests passed' WHEN 'BUILD_PASSED' THEN 'build passed' WHEN 'SESSION_COMPLETED' THEN 'session completed successfully afterwards'
      WHEN 'SUBAGENT_STARTED' THEN 'reassigned to ' || c.ag WHEN 'AGENT_STARTED' THEN 'reassigned to ' || c.ag ELSE coalesce(c.command, 'command') || ' succeeded' END AS sdesc
   FROM opn o JOIN ffm c ON c.session_id = o.session_id AND (c.ts_ms, c.input_index) = o.endpos
   WHERE c.type <> 'SESSION_COMPLETED' OR coalesce(c.meta_outcome = 'success' OR c.meta_status = 'success', FALSE)),
pb0 AS (
  SELECT o.session_id, o.family, o.id AS event_id, o.ts_ms, o.input_index, o.ag AS agent_id, o.kind, o.category, CAST(NULL AS VARCHAR) AS provider_detail, a.attempts, o.fdesc AS description,
    o.identity, o.file_path, FALSE AS alone, s.sid AS signal_event_id, s.sms AS signal_ms, s.stype, s.sdesc AS signal_description, o.pos, o.endpos
  FROM opn o JOIN att a ON a.opener = o.id LEFT JOIN sigrow s ON s.opener = o.id
  UNION ALL
  SELECT f.session_id, f.family, f.id, f.ts_ms, f.input_index, f.ag, f.kind, f.category, f.detail, 1,
    CASE WHEN f.category = 'PROVIDER' THEN 'Provider issue — ' || CASE f.detail WHEN 'QUOTA' THEN 'quota exceeded' WHEN 'AUTH' THEN 'authentication failed' WHEN 'RATE_LIMIT' THEN 'rate limited' ELSE 'provider error' END
      ELSE 'Environment issue — transport/network failure' END,
    f.identity, f.file_path, TRUE, NULL, NULL, NULL, NULL, NULL, NULL
  FROM fz f WHERE f.external AND f.id NOT IN (SELECT id FROM absorbed)),
pb AS (SELECT p.*, CASE WHEN alone THEN CASE WHEN l.running THEN 'PENDING' ELSE 'BLOCKED' END
   WHEN stype IS NOT NULL THEN CASE WHEN kind = 'agent-failure' OR (kind = 'test-failure' AND stype = 'TEST_PASSED') OR (kind = 'build-failure' AND stype = 'BUILD_PASSED')
       OR (kind IN ('command-failure','timeout','abort') AND stype = 'COMMAND_COMPLETED') THEN 'RECOVERED' ELSE 'POSSIBLY_RECOVERED' END
   WHEN l.running THEN 'PENDING' ELSE 'UNRESOLVED' END AS status
  FROM pb0 p JOIN lc l USING (session_id))"""

_STEPS = """
allsteps AS (SELECT p.session_id, p.event_id, c.id AS step_event_id, c.ts_ms AS step_ms, c.file_path AS step_path,
   CASE c.type WHEN 'FILE_CREATED' THEN coalesce(c.file_path,'file') || ' created' WHEN 'FILE_DELETED' THEN coalesce(c.file_path,'file') || ' deleted'
     WHEN 'FILE_CHANGED' THEN coalesce(c.file_path,'file') || ' changed' WHEN 'FILE_READ' THEN 'inspected ' || coalesce(c.file_path,'file')
     ELSE 'ran ' || coalesce(c.command, c.tool_name, 'verification') END AS description,
   row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts_ms, c.input_index) AS step_no, count(*) OVER (PARTITION BY p.event_id) AS follow_up_count
  FROM pb p JOIN ffm c ON c.session_id = p.session_id AND c.family = p.family AND NOT p.alone
   AND c.type IN ('FILE_CHANGED','FILE_CREATED','FILE_DELETED','FILE_READ','COMMAND_STARTED','TEST_STARTED','BUILD_STARTED')
   AND (c.ts_ms, c.input_index) > p.pos AND (p.endpos IS NULL OR (c.ts_ms, c.input_index) < p.endpos)),
steps AS (SELECT session_id, event_id, follow_up_count, step_no, step_event_id, step_ms, description FROM allsteps WHERE step_no <= 12)"""

_OUTCOME = """
ct AS (SELECT session_id, count(DISTINCT CASE WHEN type IN ('FILE_CREATED','FILE_CHANGED','FILE_DELETED') AND file_path <> '' THEN file_path END) AS files_changed,
   count(*) FILTER (WHERE type = 'TEST_PASSED') AS tests_passed, count(*) FILTER (WHERE type = 'TEST_FAILED') AS tests_failed,
   count(*) FILTER (WHERE type = 'BUILD_PASSED') AS builds_passed, count(*) FILTER (WHERE type = 'BUILD_FAILED') AS builds_failed,
   count(*) FILTER (WHERE type = 'COMMAND_COMPLETED') AS commands_run, count(*) FILTER (WHERE type = 'COMMAND_COMPLETED' AND failure) AS commands_failed FROM ff GROUP BY 1),
ps AS (SELECT session_id, count(*) AS problems, CAST(sum(attempts) AS BIGINT) AS failures, count(*) FILTER (WHERE status IN ('RECOVERED','POSSIBLY_RECOVERED')) AS recovered,
   count(*) FILTER (WHERE status = 'UNRESOLVED') AS unresolved, count(*) FILTER (WHERE status = 'BLOCKED') AS blocked FROM pb GROUP BY 1),
oc AS (SELECT l.*, c.* EXCLUDE (session_id), coalesce(p.problems, 0) AS problems, coalesce(p.failures, 0) AS failures, coalesce(p.recovered, 0) AS recovered,
   coalesce(p.unresolved, 0) AS unresolved, coalesce(p.blocked, 0) AS blocked, (SELECT count(*) FROM ag a WHERE a.session_id = l.session_id) AS agents,
   CASE WHEN declared_outcome = 'success' THEN 'SUCCESS' WHEN declared_outcome IN ('failure','error') THEN 'FAILED' WHEN declared_outcome IN ('blocked','stopped') THEN 'BLOCKED'
     WHEN declared_outcome = 'partial' THEN 'PARTIAL' WHEN declared_outcome IS NOT NULL OR session_status <> 'COMPLETED' THEN 'UNKNOWN'
     WHEN coalesce(p.unresolved,0) > 0 THEN 'FAILED' WHEN coalesce(p.blocked,0) > 0 THEN 'BLOCKED' WHEN coalesce(p.recovered,0) = coalesce(p.problems,0) THEN 'SUCCESS' ELSE 'PARTIAL' END AS outcome
  FROM lc l JOIN ct c USING (session_id) LEFT JOIN ps p USING (session_id))"""

_ATTENTION = """
aw AS (SELECT session_id, count(*) AS n,
   arg_min({'c': category, 'd': provider_detail, 's': description}, (ts_ms, input_index)) FILTER (WHERE status = 'BLOCKED') AS b,
   arg_min({'c': category, 'd': provider_detail, 's': description}, (ts_ms, input_index)) FILTER (WHERE category IN ('PROVIDER','ENVIRONMENT')) AS x,
   arg_min({'c': category, 'd': provider_detail, 's': description}, (ts_ms, input_index)) FILTER (WHERE status = 'UNRESOLVED') AS u,
   arg_min({'c': category, 'd': provider_detail, 's': description}, (ts_ms, input_index)) FILTER (WHERE status IN ('PENDING','POSSIBLY_RECOVERED')) AS w FROM pb GROUP BY 1),
at0 AS (SELECT l.session_id, a.*EXCLUDE (session_id), CASE WHEN b IS NOT NULL OR (running AND x IS NOT NULL) THEN 1 WHEN u IS NOT NULL THEN 2 WHEN running AND w IS NOT NULL THEN 3
   WHEN running AND n > 0 THEN 4 WHEN running THEN 5 ELSE 6 END AS tier FROM lc l LEFT JOIN aw a USING (session_id)),
at1 AS (SELECT session_id, tier, CASE tier WHEN 1 THEN coalesce(b, x) WHEN 2 THEN u WHEN 3 THEN w END AS h FROM at0),
att6 AS (SELECT session_id, tier, CASE tier WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'RECOVERY IN PROGRESS' WHEN 4 THEN 'RUNNING · HAD PROBLEMS' WHEN 5 THEN 'RUNNING' ELSE 'IDLE' END AS label,
   h.c AS problem_category, h.d AS provider_detail, h.s AS problem_summary, CASE tier WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'UNRESOLVED' WHEN 3 THEN 'RECOVERY IN PROGRESS' END AS recovery_state FROM at1)"""

_TASKS = """
tk AS (SELECT session_id, coalesce(
   arg_min(summary, (ts_ms, input_index)) FILTER (WHERE said AND meta_role = 'user' AND shaped AND length(summary) <= 200),
   arg_min(summary, (ts_ms, input_index)) FILTER (WHERE said AND meta_role = 'user' AND shaped),
   arg_min(summary, (ts_ms, input_index)) FILTER (WHERE said)) AS task
  FROM (SELECT *, coalesce(type = 'MESSAGE' AND length(summary) > 0, FALSE) AS said, substr(summary,1,1) NOT IN ('<','/','#') AS shaped FROM se) GROUP BY 1),
cd AS (SELECT session_id, bool_or(type IN ('FILE_READ','FILE_CREATED','FILE_CHANGED','FILE_DELETED','COMMAND_STARTED','COMMAND_COMPLETED','TEST_STARTED','TEST_PASSED','TEST_FAILED','BUILD_STARTED','BUILD_PASSED','BUILD_FAILED','TOOL_CALLED','TOOL_RESULT')) AS coding FROM se GROUP BY 1)"""

_LIST = """
li AS (SELECT o.session_id, coalesce(t.task, o.session_id) AS label, o.project, c.coding, CASE WHEN o.running THEN 'RUNNING' ELSE o.outcome END AS status, o.running,
   CAST(a.tier AS INT) AS tier, a.label AS attention_label, a.problem_category, a.problem_summary, a.recovery_state, o.duration_ms, o.last_ms, o.problems, o.recovered, o.unresolved, o.agents, o.files_changed, o.source
   FROM oc o JOIN tk t USING (session_id) JOIN att6 a USING (session_id) JOIN cd c USING (session_id))"""

_KEEP = """
seed AS (SELECT session_id, event_id AS id FROM pb UNION SELECT session_id, signal_event_id FROM pb WHERE signal_event_id IS NOT NULL UNION SELECT session_id, step_event_id FROM steps),
anc AS (SELECT * FROM seed UNION SELECT a.session_id, e.parent_id FROM anc a JOIN se e ON e.session_id = a.session_id AND e.id = a.id WHERE e.parent_id IS NOT NULL),
roots AS (SELECT session_id, id, CAST(-1 AS BIGINT) AS ms, CAST(-1 AS BIGINT) AS ix FROM anc UNION SELECT session_id, id, ts_ms, input_index FROM se WHERE type IN ('SESSION_STARTED','SESSION_COMPLETED')),
des AS (SELECT * FROM roots UNION SELECT d.session_id, e.id, e.ts_ms, e.input_index FROM des d JOIN se e ON e.session_id = d.session_id AND e.parent_id = d.id AND (e.ts_ms, e.input_index) > (d.ms, d.ix)),
kept AS (SELECT DISTINCT e.session_id, e.id FROM se e JOIN des d ON d.session_id = e.session_id AND d.id = e.id)"""


def _sql(final: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([bind.SESSION_EVENTS_SQL, *ctes]) + "\n" + final


_P = (_FAIL, _AGENTS, _FAMILY, _LIFE, _PROBLEMS)
_OBSERVED = """
  CASE type WHEN 'TEST_PASSED' THEN 'tests passed' WHEN 'TEST_FAILED' THEN 'tests failed' WHEN 'BUILD_PASSED' THEN 'build passed' WHEN 'BUILD_FAILED' THEN 'build failed'
    WHEN 'COMMAND_STARTED' THEN 'ran ' || coalesce(command, tool_name, 'a command') WHEN 'COMMAND_COMPLETED' THEN 'ran ' || coalesce(command, tool_name, 'a command')
    WHEN 'FILE_CHANGED' THEN 'modified ' || coalesce(file_path,'a file') WHEN 'FILE_CREATED' THEN 'created ' || coalesce(file_path,'a file')
    WHEN 'FILE_DELETED' THEN 'deleted ' || coalesce(file_path,'a file') WHEN 'FILE_READ' THEN 'read ' || coalesce(file_path,'a file')
    WHEN 'TEST_STARTED' THEN coalesce(summary,'activity') WHEN 'BUILD_STARTED' THEN coalesce(summary,'activity') END"""

ORACLES = {
    "ses_index_events": _sql("SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, input_index) AS position, ts_ms - min(ts_ms) OVER (PARTITION BY session_id) AS offset_ms, type FROM se"),
    "ses_lifecycle": _sql("SELECT * FROM lc", _LIFE),
    "ses_task": _sql("SELECT session_id, CASE WHEN length(task) > 120 THEN substr(task,1,119) || '…' ELSE task END AS task FROM tk", _TASKS),
    "ses_agent_graph": _sql("SELECT * FROM ag", _AGENTS),
    "ses_agent_items": _sql("""SELECT session_id, agent_id, item, value, pos[1] AS ts_ms, pos[2] AS input_index FROM (
       SELECT session_id, ag AS agent_id, item, value, min([ts_ms, input_index]) AS pos FROM (
         SELECT *, 'file' AS item, file_path AS value FROM ff WHERE type IN ('FILE_CREATED','FILE_CHANGED','FILE_DELETED')
         UNION ALL SELECT *, 'command', command FROM ff WHERE type IN ('COMMAND_STARTED','COMMAND_COMPLETED')
         UNION ALL SELECT *, 'error', coalesce(identity, fdesc) FROM ff WHERE failure AND type NOT IN ('COMMAND_COMPLETED','TOOL_RESULT')) WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4)""", _FAIL),
    "ses_agent_children": _sql("SELECT session_id, parent AS agent_id, agent_id AS child, min([ts_ms, input_index])[1] AS ts_ms, min([ts_ms, input_index])[2] AS input_index FROM st GROUP BY 1, 2, 3", _AGENTS),
    "ses_root_agent": _sql("""SELECT a.session_id, a.agent_id, CASE WHEN a.status = 'UNKNOWN' AND o.session_status = 'COMPLETED' AND o.outcome IN ('SUCCESS','FAILED')
       AND a.agent_id = CASE WHEN EXISTS (SELECT 1 FROM ag m WHERE m.session_id = a.session_id AND m.agent_id = 'main') THEN 'main'
          ELSE (SELECT arg_min(ag, (ts_ms, input_index)) FROM ff e WHERE e.session_id = a.session_id) END THEN o.outcome ELSE a.status END AS status FROM ag a JOIN oc o USING (session_id)""", *_P, _OUTCOME),
    "ses_agent_families": _sql("SELECT * FROM fam", _AGENTS, _FAMILY),
    "ses_file_touches": _sql("""SELECT session_id, file_path AS path, count(*) FILTER (WHERE type = 'FILE_CREATED') AS created, count(*) FILTER (WHERE type = 'FILE_CHANGED') AS changed,
       count(*) FILTER (WHERE type = 'FILE_DELETED') AS deleted, count(*) FILTER (WHERE type = 'FILE_READ') AS reads, count(*) FILTER (WHERE type IN ('FILE_CREATED','FILE_CHANGED','FILE_DELETED')) AS edits,
       sum(meta_additions) AS additions, sum(meta_deletions) AS deletions, arg_min(coalesce(agent_id,'main'), (ts_ms, input_index)) AS first_touched_by,
       arg_max(coalesce(agent_id,'main'), (ts_ms, input_index)) AS last_touched_by, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM se WHERE file_path IS NOT NULL GROUP BY 1, 2"""),
    "ses_file_agents": _sql("SELECT session_id, file_path AS path, coalesce(agent_id,'main') AS agent_id, min([ts_ms, input_index])[1] AS ts_ms, min([ts_ms, input_index])[2] AS input_index FROM se WHERE file_path IS NOT NULL GROUP BY 1, 2, 3"),
    "ses_failures": _sql("SELECT id, kind, identity, category, detail, fdesc AS description FROM ff WHERE failure", _FAIL),
    "ses_detect_problems": _sql("SELECT session_id, event_id, kind, category, provider_detail, CAST(attempts AS BIGINT) AS attempts, description FROM pb", *_P),
    "ses_recovery_signals": _sql("SELECT event_id, signal_event_id, signal_ms, signal_description FROM pb WHERE signal_event_id IS NOT NULL", *_P),
    "ses_problem_status": _sql("SELECT event_id, status, alone FROM pb", *_P),
    "ses_problem_numbers": _sql("SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, input_index) AS problem_no FROM pb", *_P),
    "ses_follow_ups": _sql("SELECT * FROM steps", *_P, _STEPS),
    "ses_file_involvement": _sql("""SELECT DISTINCT e.session_id, e.file_path AS path,
       EXISTS (SELECT 1 FROM allsteps a WHERE a.session_id = e.session_id AND a.step_path = e.file_path)
       OR EXISTS (SELECT 1 FROM pb p WHERE NOT p.alone AND p.identity IS NOT NULL AND p.session_id = e.session_id AND p.file_path = e.file_path) AS involved_in_problems
       FROM se e WHERE e.file_path IS NOT NULL""", *_P, _STEPS),
    "ses_outcome": _sql("SELECT session_id, outcome, files_changed, tests_passed, tests_failed, builds_passed, builds_failed, commands_run, commands_failed, failures, recovered, unresolved, blocked, agents FROM oc", *_P, _OUTCOME),
    "ses_problems_only": _sql("SELECT * FROM kept", *_P, _STEPS, _KEEP),
    "ses_hidden_count": _sql("SELECT session_id, count(*) - count(k.id) AS hidden FROM se LEFT JOIN kept k USING (session_id, id) GROUP BY 1", *_P, _STEPS, _KEEP),
    "ses_coding": _sql("SELECT * FROM cd", _TASKS),
    "ses_attention": _sql("SELECT * REPLACE (CAST(tier AS INT) AS tier) FROM att6", *_P, _ATTENTION),
    "ses_attention_order": _sql("SELECT session_id, CAST(tier AS DOUBLE) * 1e15 + greatest(0, (SELECT max(ts_ms) FROM se) - last_ms) AS sort_key FROM att6 JOIN lc USING (session_id)", *_P, _ATTENTION),
    "ses_radar": _sql("""SELECT session_id, 'needs attention' AS section, tier, last_ms FROM li WHERE coding AND tier <= 3 UNION ALL
       SELECT * FROM (SELECT session_id, 'everything else', tier, last_ms FROM li WHERE coding AND tier > 3 ORDER BY tier, last_ms DESC, session_id LIMIT 12)""", *_P, _OUTCOME, _ATTENTION, _TASKS, _LIST),
    "ses_last_observed": _sql(f"""SELECT session_id, coalesce(arg_max(lab, (ts_ms, input_index)) FILTER (WHERE lab IS NOT NULL),
       arg_max(coalesce(nullif(summary,''), 'reported an error'), (ts_ms, input_index)) FILTER (WHERE type NOT IN ('SESSION_STARTED','SESSION_COMPLETED') AND (length(summary) > 0 OR type = 'ERROR'))) AS last_observed
       FROM (SELECT *, {_OBSERVED} AS lab FROM se) GROUP BY 1"""),
    "ses_liveness": _sql("SELECT session_id, running FROM lc", _LIFE),
    "ses_list": _sql("SELECT * FROM li", *_P, _OUTCOME, _ATTENTION, _TASKS, _LIST),
    "ses_list_filter": _sql("SELECT session_id, label, problems FROM li WHERE problems > 0 AND (contains(lower(label), 'message 2') OR contains(lower(session_id), 'message 2'))", *_P, _OUTCOME, _ATTENTION, _TASKS, _LIST),
    "ses_day_groups": _sql("""SELECT CASE WHEN last_ms >= day THEN 'Today' WHEN last_ms >= day - 86400000 THEN 'Yesterday' ELSE 'Earlier' END AS heading, count(*) AS sessions
       FROM lc, (SELECT max(ts_ms) - max(ts_ms) % 86400000 AS day FROM se) GROUP BY 1""", _LIFE),
    "ses_progress_steps": _sql("""
       SELECT session_id, 0 AS step_group, CAST(0 AS BIGINT) AS at_ms, '○' AS glyph, task AS label, CAST(NULL AS VARCHAR) AS detail FROM tk WHERE task IS NOT NULL
       UNION ALL SELECT session_id, 1, ts_ms, '✕', description, NULL FROM pb
       UNION ALL SELECT session_id, 1, ts_ms, '↻', 'Recovery: ' || coalesce(signal_description, 'signal observed'), CAST(attempts AS VARCHAR) || CASE WHEN attempts = 1 THEN ' attempt' ELSE ' attempts' END FROM pb WHERE status IN ('RECOVERED','POSSIBLY_RECOVERED')
       UNION ALL SELECT a.session_id, 2, 0, '●', a.agent_id || ' running', NULL FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(started_ms,0) DESC, agent_id DESC) AS rn FROM ag) a JOIN lc l USING (session_id) WHERE rn = 1 AND a.status = 'RUNNING' AND l.session_status = 'RUNNING'
       UNION ALL SELECT session_id, 3, 0, CASE WHEN outcome = 'FAILED' THEN '✕' ELSE '✓' END, 'Outcome: ' || outcome, NULL FROM oc WHERE outcome <> 'UNKNOWN'
       UNION ALL SELECT session_id, 4, 0, '●', 'Session activity recorded', NULL FROM oc o WHERE outcome = 'UNKNOWN' AND problems = 0 AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.session_id = o.session_id AND task IS NOT NULL)
         AND NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(started_ms,0) DESC, agent_id DESC) AS rn FROM ag) a WHERE a.session_id = o.session_id AND rn = 1 AND a.status = 'RUNNING' AND o.session_status = 'RUNNING')""", *_P, _OUTCOME, _TASKS),
    "ses_problem_summary": _sql("SELECT session_id, kind, status, count(*) AS problems, CAST(sum(attempts) AS BIGINT) AS attempts FROM pb GROUP BY 1, 2, 3", *_P),
}
