"""Registered ingest queries (ING) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from . import bind
from .silver import silver


def stamped(s, d):
    return silver(s, d, "stamped", lambda: I.stamp_sequence(bind.records(s, d))[0])


def parts(s, d):
    return I.dedup_records(stamped(s, d))


def receipts(s, d):
    """Accepted answer records in (first line of the run, sequence) order."""
    order = stamped(s, d).groupBy("run_id").agg(F.min("line_no").alias("run_order"))
    return parts(s, d)[0].where("record_kind = 'answer'").withColumnRenamed("record_id", "receipt_id").join(order, "run_id")


def lifecycle(s, d):
    return I.fold_lifecycle(stamped(s, d).where("record_kind = 'run'").select("run_id", "sequence", "lifecycle"))


def completeness(s, d):
    """A line whose content hash starts with ``00`` stands for a lost line of its file."""
    r = stamped(s, d)
    lost = r.where("content_hash like '000%'").select("file")
    return I.batch_completeness(r, lost, lost.limit(0), I.receipt_conflicts(receipts(s, d))[1])


def diagnostics(s, d):
    return silver(s, d, "diagnostics", lambda: I.stamp_sequence(bind.records(s, d))[1].unionByName(parts(s, d)[2]).unionByName(lifecycle(s, d)[2]))


def relations(s, d):
    """Each event refers to the event with id ``k`` of its run; some name another run, some point forward."""
    r = stamped(s, d).where("record_kind = 'event'").withColumn("k", F.substring("record_id", 2, 9).cast("int"))
    first = r.groupBy("run_id", "record_id").agg(F.min(F.struct("sequence", "k")).alias("f"))
    return first.select(
        "run_id", F.col("record_id").alias("event_id"), F.col("f.sequence").alias("sequence"),
        F.array(F.struct(
            F.lit("SUPPORTS").alias("type"),
            F.concat(F.lit("k"), ((F.col("f.k") * 7 + 3) % 100).cast("string")).alias("target_event_id"),
            F.when(F.col("f.k") % 10 == 0, F.concat(F.lit("r"), (F.col("f.k") % 5).cast("string"))).alias("target_run_id"),
        )).alias("relations"))


def report(s, d):
    accepted, duplicates, _ = parts(s, d)
    return I.ingest_report(accepted, duplicates, lifecycle(s, d)[0], completeness(s, d))


def run_report(s, d):
    runs, history, _ = lifecycle(s, d)
    keeps = runs.where("transitions > 3")
    return I.run_report(runs, history, keeps, diagnostics(s, d))


def replay_equal(s, d):
    """Loads the same records twice, partitioned differently; the flag must be true."""
    again = I.stamp_sequence(bind.records(s, d).repartition(7))[0]
    return I.same_loads(stamped(s, d), again)


QUERIES = {
    "ing_sequence": lambda s, d: stamped(s, d).select("run_id", "line_no", "sequence"),
    "ing_sequence_mismatch": lambda s, d: I.stamp_sequence(bind.records(s, d))[1],
    "ing_accepted": lambda s, d: parts(s, d)[0].select("run_id", "record_kind", "record_id", "sequence"),
    "ing_duplicates": lambda s, d: parts(s, d)[1],
    "ing_receipt_conflicts": lambda s, d: I.receipt_conflicts(receipts(s, d))[1],
    "ing_receipts_accepted": lambda s, d: I.receipt_conflicts(receipts(s, d))[0].select("run_id", "receipt_id", "answer_id", "sequence"),
    "ing_lifecycle": lambda s, d: lifecycle(s, d)[0],
    "ing_lifecycle_history": lambda s, d: lifecycle(s, d)[1],
    "ing_lifecycle_invalid": lambda s, d: lifecycle(s, d)[2],
    "ing_batch_completeness": completeness,
    "ing_live_completeness": lambda s, d: I.live_completeness(stamped(s, d).where("record_kind = 'run'"), diagnostics(s, d), stamped(s, d).where("run_id NOT LIKE '%3'")),
    "ing_foreign_runs": lambda s, d: I.reject_foreign(stamped(s, d), "r1")[1],
    "ing_relation_diagnostics": lambda s, d: I.relation_diagnostics(relations(s, d)),
    "ing_report": report,
    "ing_replay_equal": replay_equal,
    "ing_diagnostic_counts": lambda s, d: I.diagnostic_counts(diagnostics(s, d)),
    "ing_run_report": lambda s, d: run_report(s, d)[0].drop("revision"),
    "ing_recent_transitions": lambda s, d: run_report(s, d)[1],
}

_DUP = """
nm AS (SELECT * REPLACE (CASE WHEN record_kind = 'run' THEN 'run@' || sequence ELSE record_id END AS record_id) FROM rc),
fs AS (SELECT *, min(sequence) OVER w AS fseq, first_value(content_hash) OVER (PARTITION BY run_id, record_kind, record_id ORDER BY sequence) AS fhash FROM nm WINDOW w AS (PARTITION BY run_id, record_kind, record_id)),
acc AS (SELECT * FROM fs WHERE sequence = fseq),
dup AS (SELECT run_id, record_kind, record_id, CASE WHEN content_hash = fhash THEN 'IDEMPOTENT' ELSE 'CONFLICTING' END AS duplicate_kind, fseq AS first_sequence, sequence AS duplicate_sequence FROM fs WHERE sequence > fseq)"""
_LIFE = """
rr AS (SELECT run_id, sequence, lifecycle, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS i FROM rc WHERE record_kind = 'run'),
au AS (SELECT run_id, sequence, i, lifecycle, TRUE AS allowed, lifecycle AS state FROM rr WHERE i = 1
  UNION ALL SELECT r.run_id, r.sequence, r.i, r.lifecycle, ok, CASE WHEN ok THEN r.lifecycle ELSE a.state END FROM (SELECT r.*, a.state AS st,
     CASE WHEN a.state IN ('COMPLETED','FAILED','CANCELLED') THEN r.lifecycle = a.state WHEN a.state = 'RUNNING' THEN r.lifecycle <> 'CREATED' ELSE TRUE END AS ok FROM au a JOIN rr r ON r.run_id = a.run_id AND r.i = a.i + 1) r JOIN au a ON a.run_id = r.run_id AND a.i = r.i - 1),
lr AS (SELECT run_id, arg_max(state, i) AS lifecycle, count(*) FILTER (WHERE allowed) AS transitions, max(sequence) FILTER (WHERE allowed) AS last_transition FROM au GROUP BY 1),
dg AS (SELECT run_id, 'SEQUENCE_MISMATCH' AS code, 'warning' AS severity, CASE WHEN record_kind = 'event' THEN record_id END AS event_id, sequence FROM rc WHERE declared_sequence <> sequence
  UNION ALL SELECT run_id, 'DUPLICATE_CONFLICTING', CASE WHEN record_kind = 'answer' THEN 'error' ELSE 'warning' END, CASE WHEN record_kind = 'event' THEN record_id END, duplicate_sequence FROM dup WHERE duplicate_kind = 'CONFLICTING'
  UNION ALL SELECT run_id, 'RUN_TRANSITION_INVALID', 'warning', NULL, sequence FROM au WHERE NOT allowed)"""
# Receipts one by one in order: recursion over the ordered list with the set of taken identities.
_RECEIPTS = """
ro AS (SELECT a.run_id, a.record_id AS receipt_id, a.answer_id, a.sequence, row_number() OVER (ORDER BY o.fl, a.sequence) AS i FROM acc a JOIN (SELECT run_id, min(line_no) AS fl FROM rc GROUP BY 1) o USING (run_id) WHERE record_kind = 'answer'),
gr AS (SELECT CAST(0 AS BIGINT) AS i, FALSE AS ok, CAST([] AS VARCHAR[]) AS taken UNION ALL
  SELECT r.i, NOT list_contains(g.taken, r.receipt_id) AND NOT list_contains(g.taken, r.run_id || '|' || r.answer_id),
   CASE WHEN NOT list_contains(g.taken, r.receipt_id) AND NOT list_contains(g.taken, r.run_id || '|' || r.answer_id) THEN list_concat(g.taken, [r.receipt_id, r.run_id || '|' || r.answer_id]) ELSE g.taken END FROM gr g JOIN ro r ON r.i = g.i + 1),
rz AS (SELECT r.*, g.ok FROM ro r JOIN gr g USING (i))"""
_COMP = """cm AS (SELECT r.run_id, CASE WHEN bool_or(r.file IN (SELECT file FROM rc WHERE content_hash LIKE '000%')) OR r.run_id IN (SELECT run_id FROM rz WHERE NOT ok) THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness FROM rc r GROUP BY 1)"""
_REL = """
re0 AS (SELECT run_id, record_id AS event_id, min(sequence) AS sequence, CAST(substr(record_id, 2) AS INT) AS k FROM rc WHERE record_kind = 'event' GROUP BY 1, 2),
re AS (SELECT *, 'k' || ((k * 7 + 3) % 100) AS tgt, CASE WHEN k % 10 = 0 THEN 'r' || (k % 5) END AS trun FROM re0),
lk AS (SELECT r.*, t.sequence AS tseq FROM re r LEFT JOIN re t ON t.run_id = r.run_id AND t.event_id = r.tgt WHERE r.trun IS NULL OR r.trun = r.run_id),
wk AS (SELECT run_id, event_id AS src, tgt AS cur FROM lk WHERE tseq IS NOT NULL UNION SELECT w.run_id, w.src, l.tgt FROM wk w JOIN lk l ON l.run_id = w.run_id AND l.event_id = w.cur WHERE l.tseq IS NOT NULL),
cy AS (SELECT run_id, event_id, sequence FROM lk l WHERE tseq = sequence OR (tseq > sequence AND EXISTS (SELECT 1 FROM wk w WHERE w.run_id = l.run_id AND w.src = l.tgt AND w.cur = l.event_id)))"""


def _sql(final, *ctes):
    return "WITH RECURSIVE " + ",".join([bind.RECORDS_SQL, *ctes]) + "\n" + final


ORACLES = {
    "ing_sequence": _sql("SELECT run_id, line_no, sequence FROM rc"),
    "ing_sequence_mismatch": _sql("SELECT run_id, 'SEQUENCE_MISMATCH' AS code, 'warning' AS severity, CASE WHEN record_kind = 'event' THEN record_id END AS event_id, sequence FROM rc WHERE declared_sequence <> sequence"),
    "ing_accepted": _sql("SELECT run_id, record_kind, record_id, sequence FROM acc", _DUP),
    "ing_duplicates": _sql("SELECT * FROM dup", _DUP),
    "ing_receipt_conflicts": _sql("SELECT run_id, 'RECEIPT_ID_CONFLICT' AS code, 'error' AS severity, CAST(NULL AS VARCHAR) AS event_id, sequence FROM rz WHERE NOT ok", _DUP, _RECEIPTS),
    "ing_receipts_accepted": _sql("SELECT run_id, receipt_id, answer_id, sequence FROM rz WHERE ok", _DUP, _RECEIPTS),
    "ing_lifecycle": _sql("SELECT * FROM lr", _DUP, _LIFE),
    "ing_lifecycle_history": _sql("SELECT run_id, sequence, lifecycle FROM au WHERE allowed", _DUP, _LIFE),
    "ing_lifecycle_invalid": _sql("SELECT run_id, 'RUN_TRANSITION_INVALID' AS code, 'warning' AS severity, CAST(NULL AS VARCHAR) AS event_id, sequence FROM au WHERE NOT allowed", _DUP, _LIFE),
    "ing_batch_completeness": _sql("SELECT * FROM cm", _DUP, _RECEIPTS, _COMP),
    "ing_live_completeness": _sql("SELECT run_id, bool_or(lifecycle IN ('COMPLETED','FAILED','CANCELLED')) AS terminal, CASE WHEN NOT bool_or(lifecycle IN ('COMPLETED','FAILED','CANCELLED')) OR run_id LIKE '%3' THEN 'UNKNOWN' WHEN run_id IN (SELECT run_id FROM dg WHERE severity = 'error') THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness FROM rc WHERE record_kind = 'run' GROUP BY 1", _DUP, _LIFE),
    "ing_foreign_runs": _sql("SELECT run_id, 'RUN_ID_MISMATCH' AS code, 'error' AS severity, CASE WHEN record_kind = 'event' THEN record_id END AS event_id, sequence FROM rc WHERE run_id <> 'r1'"),
    "ing_relation_diagnostics": _sql("""SELECT run_id, 'CROSS_RUN_RELATION' AS code, 'warning' AS severity, event_id, sequence FROM re WHERE trun IS NOT NULL AND trun <> run_id
       UNION ALL SELECT run_id, 'DANGLING_RELATION', 'warning', event_id, sequence FROM lk WHERE tseq IS NULL UNION ALL SELECT run_id, 'CYCLE_RELATION', 'warning', event_id, sequence FROM cy""", _REL),
    "ing_report": _sql("""SELECT a.run_id, coalesce(any_value(l.lifecycle), 'UNKNOWN') AS lifecycle, any_value(c.completeness) AS completeness, count(*) FILTER (WHERE record_kind = 'event') AS events_accepted, 0 AS events_rejected, count(*) AS records_accepted,
       (SELECT count(*) FROM dup d WHERE d.run_id = a.run_id AND duplicate_kind = 'IDEMPOTENT') AS duplicates_idempotent, (SELECT count(*) FROM dup d WHERE d.run_id = a.run_id AND duplicate_kind = 'CONFLICTING') AS duplicates_conflicting
       FROM acc a LEFT JOIN lr l USING (run_id) JOIN cm c USING (run_id) GROUP BY a.run_id""", _DUP, _LIFE, _RECEIPTS, _COMP),
    "ing_replay_equal": "SELECT count(*) AS records, TRUE AS same FROM events",
    "ing_diagnostic_counts": _sql("SELECT run_id, count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS errors, CAST(0 AS BIGINT) AS losses FROM dg GROUP BY 1", _DUP, _LIFE),
    "ing_run_report": _sql("SELECT l.*, (SELECT count(*) FROM dg WHERE dg.run_id = l.run_id) AS diagnostics, transitions > 3 AS kept FROM lr l", _DUP, _LIFE),
    "ing_recent_transitions": _sql("SELECT run_id, step, sequence, lifecycle FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS step FROM au WHERE allowed) JOIN (SELECT run_id, transitions FROM lr) USING (run_id) WHERE step > transitions - 100", _DUP, _LIFE),
}
