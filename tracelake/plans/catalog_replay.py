"""Registered replay queries (REP, STR9, STR10 batch forms) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import duration_words, outcome_runs
from ..operators import replay as R
from . import bind
from .silver import silver


def events(s, d):
    return silver(s, d, "replay_events", lambda: bind.replay_events(s, d))


def segmented(s, d):
    return silver(s, d, "segmented", lambda: R.segment(events(s, d)))


def attempts(s, d):
    return silver(s, d, "attempts", lambda: R.attempts(segmented(s, d)))


def findings(s, d):
    return silver(s, d, "findings", lambda: R.findings(attempts(s, d), R.attempt_turns(segmented(s, d))))


def tokens(s, d):
    return silver(s, d, "token_records", lambda: bind.token_records(s, d))


def facts(s, d):
    return (
        R.flight_facts(events(s, d), attempts(s, d))
        .join(R.unverified_streak(attempts(s, d)).withColumnRenamed("changes", "streak_changes").drop("attempts"), "session_id", "left")
        .join(R.most_touched(events(s, d)).select("session_id", F.col("path").alias("most_touched")), "session_id", "left")
        .join(R.final_state(attempts(s, d)), "session_id", "left")
    )


def epochs(s, d):
    return events(s, d).groupBy("session_id").agg(F.min(F.col("last_ms") - F.col("ts_offset")).alias("epoch_ms"))


def session_tokens(s, d):
    """Token counter of a session: running value of its events."""
    ev = events(s, d).where("event_type = 'other'")
    from ..operators.ordered import ordered_scan, running_sum, sequence_chunk

    return ordered_scan(ev, ["session_id"], ["seq"], sequence_chunk("seq"), total_tokens=running_sum(F.floor("duration_ms"))).select(
        "session_id", F.col("last_ms").alias("ts_ms"), F.col("seq").alias("record_no"), "total_tokens")


def policies(s, d):
    return attempts(s, d).select("session_id").distinct().withColumn("policy", F.lit("OBSERVE"))


def accounting(s, d):
    """Each session is a file; one without any work event counts as unreadable."""
    files = events(s, d).groupBy("session_id", "source").agg(F.bool_or(F.col("event_type").isin("implementation", "verification")).alias("readable"))
    return R.scan_accounting(files)


QUERIES = {
    "rep_segment": lambda s, d: segmented(s, d).select("session_id", "seq", "attempt_no"),
    "rep_attempts": lambda s, d: attempts(s, d),
    "rep_attempt_turns": lambda s, d: R.attempt_turns(segmented(s, d)),
    "rep_verification_debt": lambda s, d: R.verification_debt(attempts(s, d), R.attempt_turns(segmented(s, d))),
    "rep_dead_ends": lambda s, d: R.dead_ends(R.attempt_pairs(attempts(s, d))),
    "rep_productive": lambda s, d: R.productive(R.attempt_pairs(attempts(s, d))),
    "rep_verdict": lambda s, d: R.replay_verdict(attempts(s, d), findings(s, d)),
    "rep_scan_accounting": accounting,
    "rep_corpus_totals": lambda s, d: R.corpus_totals(events(s, d), attempts(s, d), findings(s, d)),
    "rep_top_unverified": lambda s, d: R.top_unverified(findings(s, d)).select("session_id", "turns", "confidence"),
    "rep_finding_attempts": lambda s, d: R.finding_attempts(findings(s, d), attempts(s, d)).select("session_id", "kind", "detail", "attempt_no", "audit_ok", "tests_failed"),
    "rep_candidates": lambda s, d: R.candidates(findings(s, d), attempts(s, d), "productive", session_tokens(s, d), epochs(s, d)),
    "rep_tokens_in_window": lambda s, d: R.tokens_in_window(tokens(s, d), bind.order_windows(s, d)).select("window_id", "tokens"),
    "rep_flight_facts": lambda s, d: R.flight_facts(events(s, d), attempts(s, d)).withColumn("span", duration_words(F.col("span_ms"))),
    "rep_debugging_loop": lambda s, d: R.debugging_loop(attempts(s, d)),
    "rep_unverified_streak": lambda s, d: R.unverified_streak(attempts(s, d)),
    "rep_final_state": lambda s, d: R.final_state(attempts(s, d)),
    "rep_most_touched": lambda s, d: R.most_touched(events(s, d)),
    "rep_recent_coding": lambda s, d: R.recent_coding(events(s, d), "u1"),
    "rep_compare_sessions": lambda s, d: R.compare_sessions(facts(s, d), "u1", "u2"),
    "rep_attempt_timeline": lambda s, d: R.attempt_timeline(segmented(s, d), attempts(s, d)),
    "rep_escalate": lambda s, d: R.escalate(policies(s, d), findings(s, d)),
    "rep_gap_buckets": lambda s, d: R.gap_buckets(R.change_gaps(events(s, d))),
    "rep_gap_quantiles": lambda s, d: R.gap_quantiles(R.change_gaps(events(s, d))),
    "rep_batch_sizes": lambda s, d: R.batch_sizes(events(s, d)),
    "str_verify_first_batch": lambda s, d: R.verify_first(events(s, d)),
    "str_opportunities_batch": lambda s, d: R.opportunities(events(s, d)),
}

_SEG = """
wk AS (SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY seq) AS pv FROM re WHERE event_type IN ('implementation','verification')),
sg0 AS (SELECT *, CAST(sum(CASE WHEN event_type = 'implementation' AND (pv IS NULL OR pv = 'verification') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS attempt_no FROM wk),
sg AS (SELECT * FROM sg0 WHERE attempt_no > 0),
am0 AS (SELECT session_id, attempt_no, count(*) FILTER (WHERE event_type = 'implementation') AS implementation_events,
  count(*) FILTER (WHERE event_type = 'implementation' AND tool_name = 'Write') AS impl_writes,
  count(*) FILTER (WHERE event_type = 'implementation' AND tool_name <> 'Write') AS impl_edits,
  count(DISTINCT turn) FILTER (WHERE event_type = 'implementation' AND NOT test_only) AS turns,
  bool_or(event_type = 'verification') AS verified, count(*) FILTER (WHERE event_type = 'verification' AND verification_kind IS NOT NULL) AS verification_runs,
  arg_max([CASE ok WHEN TRUE THEN 'pass' WHEN FALSE THEN 'fail' ELSE 'unknown' END], seq) FILTER (WHERE verification_kind = 'build')[1] AS build_status,
  arg_max([CASE WHEN ok AND tests_failed IS NULL THEN 0 ELSE tests_failed END], seq) FILTER (WHERE verification_kind = 'test')[1] AS tests_failed,
  arg_min([failure_sig], seq) FILTER (WHERE event_type = 'verification' AND NOT ok)[1] AS failure_sig,
  arg_min(ts_offset, seq) FILTER (WHERE event_type = 'implementation') AS ts_offset, min(seq) AS first_seq, max(seq) AS last_seq,
  count(DISTINCT change_hash) AS changed_files,
  substr(sha256('set' || chr(10) || sum(DISTINCT CAST('0x' || substr(sha256(change_hash), 1, 12) AS BIGINT)) || chr(10) || sum(DISTINCT CAST('0x' || substr(sha256(change_hash), 13, 12) AS BIGINT)) || chr(10) || sum(DISTINCT CAST('0x' || substr(sha256(change_hash), 25, 12) AS BIGINT)) || chr(10) || sum(DISTINCT CAST('0x' || substr(sha256(change_hash), 37, 12) AS BIGINT))), 1, 32) AS change_hash FROM sg GROUP BY 1, 2),
am AS (SELECT * FROM am0),
tn AS (SELECT DISTINCT session_id, attempt_no, turn FROM sg WHERE event_type = 'implementation' AND NOT test_only AND turn IS NOT NULL)"""
_FIND = """
rg AS (SELECT a.* FROM am a WHERE attempt_no > coalesce((SELECT max(b.attempt_no) FROM am b WHERE b.session_id = a.session_id AND b.verified), 0)),
db0 AS (SELECT session_id, count(*) AS n, min(attempt_no) AS first_attempt, max(attempt_no) AS last_attempt, CAST(sum(impl_writes) AS BIGINT) AS writes, CAST(sum(impl_edits) AS BIGINT) AS edits,
   CAST(sum(implementation_events) AS BIGINT) AS calls, count(*) FILTER (WHERE turns = 0) AS bare, (SELECT count(DISTINCT turn) FROM tn JOIN rg r2 USING (session_id, attempt_no) WHERE tn.session_id = rg.session_id) AS dt FROM rg GROUP BY session_id),
db AS (SELECT session_id, 'verification-debt' AS kind, first_attempt, last_attempt,
   CASE WHEN dt + bare >= 3 THEN (dt + bare) || ' distinct implementation turns were made without collecting any verification evidence' WHEN dt + bare = 2 AND n >= 2 THEN '2 consecutive implementation attempts without any verification run'
     ELSE calls || ' implementation calls were made without collecting any verification evidence' END AS detail, CASE WHEN dt + bare >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
   FROM db0 WHERE NOT (writes > 0 AND edits = 0) AND (dt + bare >= 3 OR (dt + bare = 2 AND n >= 2) OR (bare > 0 AND n = 1 AND calls >= 5))),
pr AS (SELECT *, lag(verified) OVER w AS pver, lag(failure_sig) OVER w AS psig, lag(change_hash) OVER w AS phash, lag(tests_failed) OVER w AS ptf, lag(build_status) OVER w AS pbs
   FROM am WINDOW w AS (PARTITION BY session_id ORDER BY attempt_no)),
de0 AS (SELECT *, verified AND failure_sig IS NOT NULL AS us, coalesce(verified AND failure_sig IS NOT NULL AND pver AND psig = failure_sig, FALSE) AS fo FROM pr),
de1 AS (SELECT *, sum(CASE WHEN fo THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY attempt_no) AS run FROM de0),
de AS (SELECT session_id, 'dead-end' AS kind, min(attempt_no) AS first_attempt, max(attempt_no) AS last_attempt, count(*) || ' different patches, same failure signature ' || failure_sig AS detail,
   CASE WHEN count(*) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM de1 WHERE us GROUP BY session_id, run, failure_sig HAVING count(*) >= 2 AND coalesce(bool_and(change_hash IS DISTINCT FROM phash) FILTER (WHERE fo), TRUE)),
pd AS (SELECT session_id, 'productive' AS kind, attempt_no - 1 AS first_attempt, attempt_no AS last_attempt, 'failed tests ' || ptf || ' → ' || tests_failed AS detail, CASE WHEN ptf - tests_failed >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM pr WHERE tests_failed < ptf
   UNION ALL SELECT session_id, 'productive', attempt_no - 1, attempt_no, 'build went fail → pass', 'HIGH' FROM pr WHERE pbs = 'fail' AND build_status = 'pass'),
fi AS (SELECT * FROM db UNION ALL SELECT * FROM de UNION ALL SELECT * FROM pd),
oa AS (SELECT *, CASE WHEN build_status = 'pass' THEN TRUE WHEN build_status = 'fail' THEN FALSE WHEN tests_failed IS NOT NULL THEN tests_failed = 0 END AS ok FROM am)"""
_FACTS = """
ff AS (SELECT e.session_id, any_value(source) AS source, max(ts_offset) - min(ts_offset) AS span_ms,
   CASE WHEN any_value(source) = 'claude' THEN count(*) FILTER (WHERE event_type = 'observation' AND tool_name = 'Read') END AS reads,
   coalesce((SELECT CAST(sum(implementation_events) AS BIGINT) FROM am WHERE am.session_id = e.session_id), 0) AS edits,
   coalesce((SELECT CAST(sum(verification_runs) AS BIGINT) FROM am WHERE am.session_id = e.session_id), 0) AS verification_runs FROM re e GROUP BY e.session_id),
us0 AS (SELECT *, sum(CASE WHEN verified THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY attempt_no) AS run FROM am),
us1 AS (SELECT session_id, run, CAST(sum(implementation_events) AS BIGINT) AS changes, count(*) AS attempts FROM us0 WHERE NOT verified GROUP BY 1, 2),
us AS (SELECT session_id, changes, attempts FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY changes DESC, run) AS rn FROM us1) WHERE rn = 1),
mt AS (SELECT session_id, path, touches FROM (SELECT session_id, path, count(*) AS touches, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(seq)) AS rn FROM re
   WHERE (event_type = 'implementation' OR (event_type = 'observation' AND tool_name = 'Read')) AND path <> '' GROUP BY 1, 2) WHERE rn = 1),
fs AS (SELECT session_id, CASE arg_max([ok], attempt_no) FILTER (WHERE verified)[1] WHEN TRUE THEN 'recognized verification found' WHEN FALSE THEN 'last recognized verification failed' ELSE 'no recognized verification' END AS final_state FROM oa GROUP BY 1),
lo0 AS (SELECT *, sum(CASE WHEN verified THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY attempt_no) AS run FROM oa),
lo1 AS (SELECT session_id, run, min(attempt_no) FILTER (WHERE NOT ok) AS f, max(attempt_no) FILTER (WHERE ok) AS e FROM lo0 WHERE verified AND ok IS NOT NULL GROUP BY 1, 2),
lo2 AS (SELECT session_id, max(run) AS run FROM lo1 WHERE e > f GROUP BY 1),
lo AS (SELECT a.session_id, a.attempt_no, a.ok FROM lo0 a JOIN lo2 b USING (session_id, run) JOIN lo1 c USING (session_id, run) WHERE a.verified AND a.ok IS NOT NULL AND a.attempt_no <= c.e)"""


def _sql(final, *ctes):
    return "WITH " + ",".join([bind.REPLAY_EVENTS_SQL, *ctes]) + "\n" + final


_W = """CASE WHEN span_ms IS NULL OR span_ms <= 0 THEN 'n/a' WHEN span_ms < 60000 THEN CAST(CAST(floor(span_ms/1000.0+0.5) AS BIGINT) AS VARCHAR) || ' s'
  WHEN span_ms/60000.0 < 90 THEN CAST(CAST(floor(span_ms/60000.0+0.5) AS BIGINT) AS VARCHAR) || ' min'
  WHEN span_ms // 3600000 < 48 THEN (span_ms // 3600000) || ' h ' || CAST(CAST(floor(span_ms/60000.0 - (span_ms // 3600000)*60 + 0.5) AS BIGINT) AS VARCHAR) || ' min'
  ELSE (span_ms // 86400000) || 'd ' || ((span_ms // 3600000) % 24) || ' h*' END"""

ORACLES = {
    "rep_segment": _sql("SELECT session_id, seq, attempt_no FROM sg", _SEG),
    "rep_attempts": _sql("SELECT * FROM am", _SEG),
    "rep_attempt_turns": _sql("SELECT * FROM tn", _SEG),
    "rep_verification_debt": _sql("SELECT * FROM db", _SEG, _FIND),
    "rep_dead_ends": _sql("SELECT * FROM de", _SEG, _FIND),
    "rep_productive": _sql("SELECT * FROM pd", _SEG, _FIND),
    "rep_verdict": _sql("""SELECT a.session_id, count(*) AS attempts, CAST(sum(verification_runs) AS BIGINT) AS verification_runs, CAST(sum(implementation_events) AS BIGINT) AS implementation_calls,
       (SELECT count(*) FROM fi f WHERE f.session_id = a.session_id) AS findings,
       CASE (SELECT arg_max(kind, CASE kind WHEN 'verification-debt' THEN 3 WHEN 'dead-end' THEN 2 ELSE 1 END) FROM fi f WHERE f.session_id = a.session_id)
         WHEN 'verification-debt' THEN '⏸ Verification debt: ' || (SELECT max(detail) FROM db WHERE db.session_id = a.session_id) WHEN 'dead-end' THEN '⚠ Different code. Same error.' WHEN 'productive' THEN '✓ Productive progress'
         ELSE 'INCONCLUSIVE — no strong pattern in this session' END AS verdict,
       coalesce((SELECT CASE max(CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END FROM fi f WHERE f.session_id = a.session_id), 'INCONCLUSIVE') AS confidence FROM am a GROUP BY a.session_id""", _SEG, _FIND),
    "rep_scan_accounting": _sql("SELECT source, count(*) AS files, count(*) FILTER (WHERE r) AS readable, count(*) FILTER (WHERE NOT r) AS unreadable FROM (SELECT session_id, source, bool_or(event_type IN ('implementation','verification')) AS r FROM re GROUP BY 1, 2) GROUP BY 1"),
    "rep_corpus_totals": _sql("""SELECT (SELECT count(DISTINCT session_id) FROM re) AS sessions, (SELECT count(DISTINCT session_id) FROM re WHERE event_type = 'implementation') AS sessions_with_code_changes,
       (SELECT count(*) FROM am) AS attempts, (SELECT CAST(sum(implementation_events) AS BIGINT) FROM am) AS implementation_changes, (SELECT CAST(sum(verification_runs) AS BIGINT) FROM am) AS verification_runs,
       (SELECT count(DISTINCT session_id) FROM am) AS usable_sessions, (SELECT count(*) FROM fi WHERE kind = 'verification-debt') AS unverified_stretches, (SELECT count(*) FROM fi WHERE kind = 'productive') AS productive_loops,
       CAST(0 AS BIGINT) AS mobile_sessions, (SELECT count(DISTINCT (session_id, turn)) FROM re WHERE event_type = 'implementation' AND NOT test_only AND session_id IN (SELECT session_id FROM am)) AS implementation_turns""", _SEG, _FIND),
    "rep_top_unverified": _sql("SELECT session_id, CASE WHEN detail LIKE '%distinct implementation turns%' THEN CAST(regexp_extract(detail, '(\\d+) distinct', 1) AS BIGINT) ELSE 0 END AS turns, confidence FROM db ORDER BY 2 DESC, 1 LIMIT 5", _SEG, _FIND),
    "rep_finding_attempts": _sql("""SELECT f.session_id, f.kind, f.detail, a.attempt_no, CASE WHEN build_status = 'pass' THEN TRUE WHEN build_status = 'fail' THEN FALSE WHEN verification_runs > 0 THEN TRUE END AS audit_ok, a.tests_failed
       FROM fi f JOIN am a ON a.session_id = f.session_id AND a.attempt_no BETWEEN f.first_attempt AND f.last_attempt""", _SEG, _FIND),
    "rep_candidates": _sql("""SELECT c.*, CASE WHEN t1 >= fr AND tot1 - coalesce(tot0, 0) >= 0 THEN tot1 - coalesce(tot0, 0) END AS tokens FROM (
       SELECT c0.* EXCLUDE (fr, tt), fr, tt, (SELECT arg_max(total, seq) FROM tk WHERE tk.session_id = c0.session_id AND tk.last_ms < fr) AS tot0,
         (SELECT arg_max(total, seq) FROM tk WHERE tk.session_id = c0.session_id AND tk.last_ms <= tt) AS tot1, (SELECT max(last_ms) FROM tk WHERE tk.session_id = c0.session_id AND tk.last_ms <= tt) AS t1 FROM (
       SELECT f.session_id, f.kind, f.first_attempt, f.last_attempt, f.detail, f.confidence, CAST(sum(implementation_events) AS BIGINT) AS implementation_calls, CAST(sum(verification_runs) AS BIGINT) AS verification_runs,
        count(DISTINCT coalesce(change_hash, '-')) AS distinct_fingerprints, count(DISTINCT failure_sig) <= 1 AS failure_signature_stable,
        min(a.ts_offset) + any_value(ep) AS fr, max(a.ts_offset) + any_value(ep) + 60000 AS tt
       FROM pd f JOIN am a ON a.session_id = f.session_id AND a.attempt_no BETWEEN f.first_attempt AND f.last_attempt JOIN (SELECT session_id, min(last_ms - ts_offset) AS ep FROM re GROUP BY 1) e ON e.session_id = f.session_id GROUP BY 1, 2, 3, 4, 5, 6) c0) c""".replace("SELECT c.*,", "SELECT c.* EXCLUDE (fr, tt, tot0, tot1, t1),"),
       _SEG, _FIND, "tk AS (SELECT session_id, seq, last_ms, CAST(sum(floor(duration_ms)) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS total FROM re WHERE event_type = 'other')"),
    "rep_tokens_in_window": """WITH tr AS (SELECT l_orderkey, epoch_us(l_shipdate) // 1000 AS ts, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS total FROM lineitem),
       w AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 + 2592000000 AS f, epoch_us(o_orderdate) // 1000 + 34560000000 AS t FROM orders)
       SELECT 'w' || o_orderkey AS window_id, CASE WHEN max(total) FILTER (WHERE ts >= f AND ts <= t) IS NOT NULL THEN max(total) FILTER (WHERE ts <= t) - coalesce(max(total) FILTER (WHERE ts < f), 0) END AS tokens
       FROM w LEFT JOIN tr ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "rep_flight_facts": _sql(f"SELECT *, {_W} AS span FROM ff", _SEG, _FIND, _FACTS),
    "rep_debugging_loop": _sql("SELECT * FROM lo", _SEG, _FIND, _FACTS),
    "rep_unverified_streak": _sql("SELECT * FROM us", _SEG, _FIND, _FACTS),
    "rep_final_state": _sql("SELECT * FROM fs", _SEG, _FIND, _FACTS),
    "rep_most_touched": _sql("SELECT * FROM mt", _SEG, _FIND, _FACTS),
    "rep_recent_coding": _sql("SELECT session_id, count(*) FILTER (WHERE event_type = 'implementation') AS implementation_calls, max(last_ms) AS last_ms FROM re WHERE starts_with(session_id, 'u1') GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'implementation') > 0"),
    "rep_compare_sessions": _sql("""SELECT m AS metric, max(v) FILTER (WHERE session_id = 'u1') AS a, max(v) FILTER (WHERE session_id = 'u2') AS b FROM (
       SELECT session_id, unnest(['span_ms','edits','verification_runs','reads','streak_changes','most_touched','final_state']) AS m,
         unnest([CAST(span_ms AS VARCHAR), CAST(edits AS VARCHAR), CAST(ff.verification_runs AS VARCHAR), CAST(reads AS VARCHAR), CAST(us.changes AS VARCHAR), mt.path, fs.final_state]) AS v
       FROM ff LEFT JOIN us USING (session_id) LEFT JOIN mt USING (session_id) LEFT JOIN fs USING (session_id) WHERE session_id IN ('u1','u2')) GROUP BY 1""", _SEG, _FIND, _FACTS),
    "rep_attempt_timeline": _sql("""SELECT a.session_id, a.attempt_no, a.ts_offset / 1000.0 AS offset_s, implementation_events || CASE WHEN implementation_events = 1 THEN ' edit' ELSE ' edits' END AS edits, v.seq,
       CASE WHEN v.seq IS NULL THEN 'NOT VERIFIED' ELSE coalesce(v.verification_kind, 'run') || CASE v.ok WHEN FALSE THEN ': FAILED' || coalesce(' (' || v.tests_failed || ' failing)', '') WHEN TRUE THEN ': passed' || coalesce(' (' || v.tests_failed || ' failing)', '') ELSE ': unknown' END END AS verification
       FROM am a LEFT JOIN (SELECT * FROM sg WHERE event_type = 'verification') v ON v.session_id = a.session_id AND v.attempt_no = a.attempt_no""", _SEG),
    "rep_escalate": _sql("SELECT DISTINCT a.session_id, CASE WHEN EXISTS (SELECT 1 FROM db WHERE db.session_id = a.session_id) THEN 'VERIFY_FIRST' ELSE 'OBSERVE' END AS policy FROM am a", _SEG, _FIND),
    "rep_gap_buckets": _sql("""SELECT CASE WHEN g <= 10000 THEN '<=10s' WHEN g <= 60000 THEN '10-60s' WHEN g <= 300000 THEN '1-5min' WHEN g <= 1800000 THEN '5-30min' WHEN g <= 7200000 THEN '30min-2h' ELSE '>2h' END AS bucket, count(*) AS gaps
       FROM (SELECT ts_offset - lag(ts_offset) OVER (PARTITION BY session_id ORDER BY seq) AS g FROM re WHERE event_type = 'implementation') WHERE g IS NOT NULL GROUP BY 1"""),
    "rep_gap_quantiles": _sql("""SELECT p AS share, l[1 + least(len(l) - 1, CAST(floor(p * len(l)) AS BIGINT))] AS gap_ms, len(l) AS gaps FROM (SELECT list_sort(list(g)) AS l FROM
       (SELECT ts_offset - lag(ts_offset) OVER (PARTITION BY session_id ORDER BY seq) AS g FROM re WHERE event_type = 'implementation') WHERE g IS NOT NULL), (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS p)"""),
    "rep_batch_sizes": _sql("SELECT calls, count(*) AS batches, count(*) FILTER (WHERE impl > 1) AS multi_impl FROM (SELECT session_id, turn, count(*) AS calls, count(*) FILTER (WHERE event_type = 'implementation') AS impl FROM re WHERE turn IS NOT NULL GROUP BY 1, 2) WHERE impl > 0 GROUP BY 1"),
    "str_verify_first_batch": _sql("""SELECT session_id, seq, CAST(3 AS BIGINT) AS distinct_edits, episode_start FROM (SELECT *, row_number() OVER (PARTITION BY session_id, ep ORDER BY seq) AS rn, first_value(change_hash) OVER (PARTITION BY session_id, ep ORDER BY seq) AS episode_start FROM (
       SELECT session_id, ep, change_hash, min(seq) AS seq FROM (SELECT *, sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS ep FROM (
         SELECT *, event_type = 'verification' AND verification_kind IS NOT NULL AS c FROM re)) WHERE event_type = 'implementation' AND fingerprint_basis = 'content' AND change_hash IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn = 3"""),
    "str_opportunities_batch": _sql("""SELECT session_id, batch_id, CAST(3 AS BIGINT) AS opportunities FROM (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY batch_id) AS rn FROM (
       SELECT *, sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY batch_id) AS run FROM (
         SELECT session_id, batch_id, bool_or(event_type = 'verification') AS c, bool_or(event_type = 'implementation' AND NOT coalesce(test_only, FALSE)) AS i FROM re GROUP BY 1, 2) WHERE c OR i) WHERE NOT c) WHERE rn = 3"""),
}
