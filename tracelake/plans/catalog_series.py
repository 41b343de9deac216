"""Registered series queries (EVA) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as V
from . import bind
from .silver import silver


def evidence(s, d):
    return silver(s, d, "attempt_evidence", lambda: bind.attempt_evidence(s, d))


def pairs(s, d):
    return V.pair_signals(evidence(s, d))


def signals(s, d):
    return silver(s, d, "series_signals", lambda: V.series_signals(pairs(s, d)))


def goals(s, d):
    return V.goal_progress(signals(s, d), V.latest_pair(signals(s, d)), bind.contracts(evidence(s, d)))


def payloads(s, d):
    p = V.pair_payload(pairs(s, d)).withColumn("payload", F.struct("previous", "current"))
    return p.select("series_id", "idx", F.col("previous.attempt_id").alias("from_id"), F.col("current.attempt_id").alias("to_id"),
                    F.col("current.code_changed").alias("code_changed"), F.size(V.payload_issues(F.col("payload"))).alias("issues"))


QUERIES = {
    "eva_pair_signals": lambda s, d: pairs(s, d).where("prev is not null").select("series_id", "idx", "build_changed", "failed_delta", "crash_changed", "screen_changed", "code_novelty"),
    "eva_code_changing": lambda s, d: evidence(s, d).select("series_id", "idx", V.is_code_changing().alias("code_changing")),
    "eva_trailing_streaks": lambda s, d: signals(s, d).select("series_id", "crash_streak", "screen_streak", "tests_streak"),
    "eva_debt_streak": lambda s, d: signals(s, d).select("series_id", "debt_streak", V.debt_level(F.col("debt_streak")).alias("debt_level")),
    "eva_latest_pair": lambda s, d: V.latest_pair(signals(s, d)),
    "eva_dead_end": lambda s, d: signals(s, d).select("series_id", V.dead_end().alias("dead_end")),
    "eva_goal_progress": goals,
    "eva_policy": lambda s, d: V.policy(signals(s, d), goals(s, d)),
    "eva_pair_payload": payloads,
    "eva_evaluate_series": lambda s, d: V.evaluate_series(evidence(s, d), bind.contracts(evidence(s, d))).drop("details"),
}

_BASE = """
pa AS (SELECT *, lag(attempt_id) OVER w AS p_id, lag(build_status) OVER w AS p_bs, lag(tests_failed) OVER w AS p_tf, lag(crash_sig) OVER w AS p_cs, lag(screen_sig) OVER w AS p_ss,
   lag(verified) OVER w AS p_v, lag(change_hash) OVER w AS p_ch, coalesce(crash_sig, CASE WHEN verified THEN '(no crash observed)' END) AS cv,
   coalesce(changed_files, 0) > 0 OR change_hash IS NOT NULL AS cc FROM ae WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
pz AS (SELECT *, p_bs <> build_status AS build_changed, tests_failed - p_tf AS failed_delta,
   CASE WHEN p_cs IS NOT NULL AND crash_sig IS NOT NULL THEN p_cs <> crash_sig WHEN p_cs IS NOT NULL AND verified AND crash_sig IS NULL THEN TRUE END AS crash_changed,
   CASE WHEN p_ss IS NOT NULL AND screen_sig IS NOT NULL THEN p_ss <> screen_sig WHEN p_ss IS NOT NULL AND verified AND screen_sig IS NULL THEN TRUE END AS screen_changed,
   p_ch <> change_hash AS code_novelty, max(idx) OVER (PARTITION BY series_id) AS mx FROM pa),
la AS (SELECT * FROM pz WHERE idx = mx),
sk AS (SELECT a.series_id, count(*) AS attempts, count(*) FILTER (WHERE a.cc) AS changed_implementations,
   CASE WHEN any_value(l.cv) IS NULL THEN 0 ELSE any_value(l.idx) - coalesce(max(a.idx) FILTER (WHERE a.cv IS DISTINCT FROM l.cv), -1) END AS crash_streak,
   CASE WHEN any_value(l.screen_sig) IS NULL THEN 0 ELSE any_value(l.idx) - coalesce(max(a.idx) FILTER (WHERE a.screen_sig IS DISTINCT FROM l.screen_sig), -1) END AS screen_streak,
   CASE WHEN any_value(l.tests_failed) IS NULL THEN 0 ELSE any_value(l.idx) - coalesce(max(a.idx) FILTER (WHERE a.tests_failed IS DISTINCT FROM l.tests_failed), -1) END AS tests_streak,
   any_value(l.idx) - coalesce(max(a.idx) FILTER (WHERE NOT (a.cc AND NOT a.verified)), -1) AS debt_streak,
   bool_and(coalesce(a.code_novelty, FALSE)) FILTER (WHERE a.idx > 0) AS novel, bool_or(coalesce(a.crash_changed, FALSE) OR coalesce(a.screen_changed, FALSE) OR coalesce(a.failed_delta <> 0, FALSE)) FILTER (WHERE a.idx > 0) AS moved
   FROM pz a JOIN la l USING (series_id) GROUP BY 1),
lp0 AS (SELECT *, coalesce(failed_delta < 0, FALSE) AS f1, coalesce(crash_changed, FALSE) AS f2, coalesce(screen_changed, FALSE) AS f3, coalesce(build_changed, FALSE) AS f4 FROM la),
lp AS (SELECT *, CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT) + CAST(f4 AS INT) AS n FROM lp0),
lq AS (SELECT series_id, CASE WHEN n >= 2 THEN 'MULTIPLE' WHEN n = 1 THEN 'SINGLE' ELSE 'NONE' END AS runtime_change, CASE WHEN n >= 2 THEN 'HIGH' WHEN n = 1 THEN 'MEDIUM' ELSE 'LOW' END AS evidence_gain,
   concat_ws('; ', CASE WHEN f1 THEN 'failing tests ' || failed_delta END, CASE WHEN f2 THEN 'crash signature changed' END, CASE WHEN f3 THEN 'screen changed' END, CASE WHEN f4 THEN 'build status changed' END) AS details FROM lp),
co AS (SELECT series_id, crash_sig IS NOT NULL AS cmd, coalesce(tests_failed, 0) > 0 AS tmd, CASE WHEN crash_sig IS NOT NULL THEN 'screen1' END AS tgt, screen_sig AS bas FROM ae WHERE idx = 0 AND (crash_sig IS NOT NULL OR screen_sig IS NOT NULL)),
g0 AS (SELECT l.*, q.runtime_change, c.series_id IS NOT NULL AND l.p_id IS NOT NULL AS pr,
   coalesce(cmd, FALSE) AND p_cs IS NOT NULL AND crash_sig IS NULL AND verified AS removed, tgt IS NOT NULL AND p_ss IS DISTINCT FROM tgt AND screen_sig IS NOT DISTINCT FROM tgt AS reached,
   coalesce(tmd, FALSE) AND coalesce(failed_delta < 0, FALSE) AS fewer, bas IS NOT NULL AND p_ss IS NOT DISTINCT FROM bas AND screen_sig IS DISTINCT FROM bas AS lost,
   p_cs IS NULL AND crash_sig IS NOT NULL AND verified AS newc, coalesce(cmd, FALSE) AND p_cs IS NOT NULL AND crash_sig IS NOT NULL AS persists, coalesce(cmd, FALSE) AS wc, tgt
   FROM la l JOIN lq q USING (series_id) LEFT JOIN co c USING (series_id)),
go AS (SELECT series_id, CASE WHEN NOT pr THEN 'UNKNOWN' WHEN removed OR reached THEN 'HIGH' WHEN lost OR newc THEN 'LOW' WHEN fewer THEN 'MEDIUM' WHEN runtime_change <> 'NONE' AND persists THEN 'UNKNOWN' WHEN runtime_change = 'NONE' THEN 'LOW' ELSE 'UNKNOWN' END AS goal_level,
   concat_ws('; ', CASE WHEN pr AND removed THEN 'crash disappears' END, CASE WHEN pr AND reached THEN 'target screen reached (' || tgt || ')' END, CASE WHEN pr AND fewer THEN 'failing tests decreased (' || failed_delta || ')' END) AS success_signals,
   concat_ws('; ', CASE WHEN pr AND wc AND p_cs = crash_sig THEN 'same crash' END, CASE WHEN pr AND p_ss = screen_sig THEN 'same screen' END, CASE WHEN pr AND failed_delta = 0 THEN 'same failed tests' END) AS no_progress_signals FROM g0),
dl AS (SELECT *, CASE WHEN debt_streak >= 3 THEN 'HIGH' WHEN debt_streak = 2 THEN 'MEDIUM' ELSE 'LOW' END AS debt_level, attempts >= 3 AND novel AND NOT moved AND crash_streak >= 3 AND screen_streak >= 3 AS dead FROM sk),
po AS (SELECT d.series_id, debt_level, coalesce(dead, FALSE) AS dead_end, CASE WHEN debt_level = 'HIGH' THEN 'VERIFY_FIRST' WHEN dead THEN 'RETHINK' WHEN l.build_status = 'fail' THEN 'HUMAN_REVIEW' ELSE 'OBSERVE' END AS policy,
   CASE WHEN debt_level = 'HIGH' THEN '⏸ ' || debt_streak || ' implementation attempts were made without collecting new runtime evidence.' WHEN dead THEN '⚠ Different code. Same app.' WHEN l.build_status = 'fail' THEN '‼ Build is failing — escalate for human review.'
     WHEN goal_level = 'HIGH' THEN '✓ Productive progress — goal evidence improved.' ELSE '• No strong signal yet — observe.' END AS verdict FROM dl d JOIN la l USING (series_id) JOIN go USING (series_id))"""


def _sql(final):
    return "WITH " + ",".join([bind.EVIDENCE_SQL, _BASE]) + "\n" + final


ORACLES = {
    "eva_pair_signals": _sql("SELECT series_id, idx, build_changed, failed_delta, crash_changed, screen_changed, code_novelty FROM pz WHERE idx > 0"),
    "eva_code_changing": _sql("SELECT series_id, idx, cc AS code_changing FROM pa"),
    "eva_trailing_streaks": _sql("SELECT series_id, crash_streak, screen_streak, tests_streak FROM sk"),
    "eva_debt_streak": _sql("SELECT series_id, debt_streak, debt_level FROM dl"),
    "eva_latest_pair": _sql("SELECT * FROM lq"),
    "eva_dead_end": _sql("SELECT series_id, dead_end FROM po"),
    "eva_goal_progress": _sql("SELECT * FROM go"),
    "eva_policy": _sql("SELECT * FROM po"),
    "eva_pair_payload": _sql("SELECT series_id, idx, p_id AS from_id, attempt_id AS to_id, cc AS code_changed, 0 AS issues FROM pz WHERE idx > 0"),
    "eva_evaluate_series": _sql("SELECT d.series_id, attempts, changed_implementations, crash_streak, screen_streak, tests_streak, debt_streak, runtime_change, evidence_gain, goal_level, success_signals, no_progress_signals, p.debt_level, p.dead_end, p.policy, p.verdict FROM dl d JOIN lq USING (series_id) JOIN go USING (series_id) JOIN po p USING (series_id)"),
}
