"""Registered answer queries (ANS) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from . import bind
from .silver import silver


def answers(s, d):
    return silver(s, d, "answers", lambda: bind.conversation_answers(s, d))


def scope(s, d):
    return silver(s, d, "answer_scope", lambda: bind.conversation_scope(s, d))


def events(s, d):
    return silver(s, d, "answer_events", lambda: bind.conversation_events(s, d))


def status(s, d):
    return A.answer_scope_status(answers(s, d), scope(s, d), events(s, d))


def clashes(s, d):
    """Receipts of conversations whose two turns repeat a text stand for conflicting receipts."""
    dup = bind.table(s, d, "conversations").where("turn = 0 and length(text) < 120").select(
        F.lit("answer").alias("record_kind"), F.lit("CONFLICTING").alias("duplicate_kind"),
        F.concat(F.lit("run-"), (F.col("conv_id") % 20).cast("string")).alias("run_id"),
        F.concat(F.lit("rcpt-"), F.col("conv_id").cast("string")).alias("record_id"))
    return A.conflicted_receipts(answers(s, d), dup)


def order_runs(s, d):
    """Orders as runs: status is the lifecycle, order date the last update."""
    life = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("UNKNOWN")
    return bind.table(s, d, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("run_id"), life.alias("lifecycle"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_ms"), "o_orderpriority", F.col("o_orderkey").alias("key"))


CUTOFF = 852_076_800_000  # 1997-01-01


def retention(s, d):
    runs = order_runs(s, d)
    return A.retention_candidates(runs, runs.where("o_orderpriority = '1-URGENT'"), runs.where("o_orderpriority = '5-LOW' and key % 2 = 0"), CUTOFF).select("run_id", "lifecycle", "updated_ms")


def contexts(s, d):
    return A.validate_context(bind.answer_contexts(s, d))


def selections(s, d):
    """Every conversation turn selects its receipt; the stored log starts empty."""
    t = bind.table(s, d, "conversations")
    chosen = t.select(F.concat(F.lit("run-"), (F.col("conv_id") % 25).cast("string")).alias("run_id"),
                      F.when(F.col("turn") > 0, F.concat(F.lit("rcpt-"), F.col("conv_id").cast("string"))).alias("receipt_id"),
                      F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("selection"))
    return A.record_selection(chosen.limit(0), chosen, answers(s, d), answers(s, d).select("run_id").distinct())


QUERIES = {
    "ans_scope_status": status,
    "ans_missing_events": lambda s, d: A.missing_events(answers(s, d), scope(s, d), events(s, d)).select("receipt_id", "event_id"),
    "ans_resolve": lambda s, d: A.resolve_answers(contexts(s, d)[0], answers(s, d), status(s, d), clashes(s, d)),
    "ans_validate_context": lambda s, d: contexts(s, d)[0].select("context_id"),
    "ans_conflicted_receipts": clashes,
    "ans_recent": lambda s, d: A.recent(answers(s, d), "ts_ms", "receipt_id", 50, 10).select("receipt_id", "ts_ms"),
    "ans_picker_page": lambda s, d: A.picker_page(answers(s, d), order_runs(s, d), 20, 5),
    "ans_event_page": lambda s, d: A.event_page(events(s, d), "run-3", 0, 30, None, 4000).select("event_id", "sequence", "bytes"),
    "ans_scoped_extent": lambda s, d: A.scoped_extent(scope(s, d), answers(s, d), events(s, d)),
    "ans_report": lambda s, d: A.answer_report(answers(s, d), answers(s, d).select("run_id").distinct().withColumn("lifecycle", F.lit("COMPLETED")), status(s, d), clashes(s, d)),
    "ans_retention": retention,
    "ans_selections": selections,
}


def _sql(final, *ctes):
    return "WITH " + ",".join([bind.CONVERSATION_SQL, *ctes]) + "\n" + final


_CLASH = "cl AS (SELECT DISTINCT 'rcpt-' || conv_id AS receipt_id, 'run-' || (conv_id % 20) AS run_id FROM conversations WHERE turn = 0 AND length(text) < 120 AND conv_id IN (SELECT conv_id FROM an))"
_RESOLVE = """
bs AS (SELECT *, CASE WHEN agent_id IS NOT NULL AND agent_session_id IS NOT NULL AND turn_id IS NOT NULL THEN 'session-turn' WHEN receipt_id IS NOT NULL THEN 'receipt' WHEN answer_hash IS NOT NULL THEN 'hash-only' ELSE 'none' END AS basis FROM cx),
cd AS (SELECT b.context_id, a.*, count(*) OVER (PARTITION BY b.context_id) AS n FROM bs b JOIN an a ON (b.basis = 'session-turn' AND a.agent_id = b.agent_id AND a.agent_session_id = b.agent_session_id AND a.turn_id = b.turn_id) OR (b.basis = 'receipt' AND a.receipt_id = b.receipt_id)),
c1 AS (SELECT context_id, any_value(n) AS n, any_value(receipt_id) AS rid FROM cd GROUP BY 1),
rs AS (SELECT b.context_id, b.basis, c.rid, CASE WHEN basis = 'hash-only' THEN 'uncertain:HASH_CANNOT_ESTABLISH_IDENTITY' WHEN basis = 'none' THEN 'uncertain:ANSWER_CONTEXT_REQUIRED'
   WHEN c.n IS NULL THEN CASE basis WHEN 'session-turn' THEN 'missing:TURN_NOT_FOUND' ELSE 'missing:RECEIPT_NOT_FOUND' END WHEN c.n > 1 THEN 'uncertain:MULTIPLE_FINAL_ANSWERS_FOR_TURN'
   WHEN b.agent_id <> a.agent_id THEN 'mismatch:CONFLICTING_AGENTID' WHEN b.run_id <> a.run_id THEN 'mismatch:CONFLICTING_RUNID' WHEN b.answer_hash <> a.answer_hash THEN 'mismatch:CONFLICTING_ANSWERHASH'
   WHEN b.answer_hash IS NOT NULL AND b.hash_version IS DISTINCT FROM a.hash_version THEN 'mismatch:HASH_POLICY_REQUIRED' WHEN b.basis <> 'none' AND a.receipt_id IN (SELECT receipt_id FROM cl) THEN 'mismatch:RECEIPT_PAYLOAD_CONFLICT'
   WHEN s.status <> 'EXPLICIT' THEN 'uncertain:ANSWER_SCOPE_UNKNOWN' WHEN b.answer_hash IS NOT NULL THEN 'matched:IDENTITY_AND_HASH_CORROBORATED' ELSE 'matched:EXPLICIT_IDENTITY' END AS v
  FROM bs b LEFT JOIN c1 c USING (context_id) LEFT JOIN an a ON a.receipt_id = c.rid LEFT JOIN ss s ON s.receipt_id = c.rid)"""
_RUNS = """orn AS (SELECT 'o' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'RUNNING' ELSE 'UNKNOWN' END AS lifecycle, epoch_us(o_orderdate) // 1000 AS updated_ms, o_orderpriority, o_orderkey AS key FROM orders)"""

ORACLES = {
    "ans_scope_status": _sql("SELECT * FROM ss"),
    "ans_missing_events": _sql("SELECT receipt_id, event_id FROM sc s WHERE NOT EXISTS (SELECT 1 FROM ce e WHERE e.run_id = s.run_id AND e.event_id = s.event_id)"),
    "ans_resolve": _sql("SELECT context_id, basis, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS reason, CASE WHEN v LIKE 'matched%' THEN rid END AS matched_receipt FROM rs", bind.CONTEXT_SQL, _CLASH, _RESOLVE),
    "ans_validate_context": _sql("SELECT context_id FROM cx", bind.CONTEXT_SQL),
    "ans_conflicted_receipts": _sql("SELECT * FROM cl", _CLASH),
    "ans_recent": _sql("SELECT receipt_id, ts_ms FROM an ORDER BY ts_ms DESC, receipt_id LIMIT 50 OFFSET 10"),
    "ans_picker_page": _sql("SELECT * FROM (SELECT 'answer' AS section, receipt_id AS id, run_id, ts_ms FROM an ORDER BY ts_ms DESC, receipt_id LIMIT 21 OFFSET 5) UNION ALL SELECT * FROM (SELECT 'run', run_id, run_id, updated_ms FROM orn ORDER BY updated_ms DESC, run_id LIMIT 21 OFFSET 5)", _RUNS),
    "ans_event_page": _sql("SELECT event_id, sequence, bytes FROM (SELECT *, CAST(sum(n_bytes) OVER (ORDER BY sequence) AS BIGINT) AS bytes FROM (SELECT * FROM ce WHERE run_id = 'run-3' AND sequence > 0 ORDER BY sequence LIMIT 30)) WHERE bytes = n_bytes OR bytes <= 4000"),
    "ans_scoped_extent": _sql("SELECT receipt_id, count(*) AS events, max(sequence) AS max_sequence FROM sc JOIN ce USING (run_id, event_id) GROUP BY 1"),
    "ans_report": _sql("""SELECT a.receipt_id, a.run_id, 'COMPLETED' AS lifecycle, CASE WHEN a.receipt_id IN (SELECT receipt_id FROM cl) THEN 'CONFLICTED' ELSE 'STORED' END AS receipt_integrity,
       CASE WHEN agent_session_id IS NOT NULL AND turn_id IS NOT NULL THEN 'YES' ELSE 'PARTIAL' END AS association_capability, status, missing, conflicts, event_count, CASE WHEN a.scope_declared THEN own_declared END AS own_declared, shared_declared, 'UNKNOWN' AS support
       FROM an a JOIN ss s USING (receipt_id)""", _CLASH),
    "ans_retention": _sql("SELECT run_id, lifecycle, updated_ms FROM orn WHERE updated_ms < 852076800000 AND lifecycle NOT IN ('RUNNING','CREATED') AND o_orderpriority <> '1-URGENT' AND NOT (o_orderpriority = '5-LOW' AND key % 2 = 0)", _RUNS),
    "ans_selections": _sql("SELECT 'run-' || (conv_id % 25) AS run_id, CASE WHEN turn > 0 THEN 'rcpt-' || conv_id END AS receipt_id, conv_id || '-' || turn AS selection FROM conversations c WHERE ('run-' || (conv_id % 25)) IN (SELECT run_id FROM an) AND (turn = 0 OR EXISTS (SELECT 1 FROM an WHERE an.receipt_id = 'rcpt-' || c.conv_id AND an.run_id = 'run-' || (c.conv_id % 25)))"),
}
