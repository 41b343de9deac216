"""Registered queries of the chain from lines to the ingest report (CMP6): events written as trace files with losses and refusals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import spread
from . import bind
from .intake import Intake, ingest_lines


def trace_lines(s, d):
    """Events as trace records in four files of forty runs: events with relations, run states and receipts, every id given twice.

    Files 0 and 1 have torn and blank lines, files 1 and 2 records of a future schema and unknown states.
    """
    e = spread(bind.table(s, d, "events").select("event_id", "props")).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("m", F.floor(F.col("event_id") / 6).cast("bigint"))
    e = e.withColumns({"run": F.col("m") % 40, "file_no": F.col("m") % 4})
    k, eid, m, text = F.col("k"), F.col("event_id"), F.col("m"), lambda c: c.cast("string")
    refusing = F.col("file_no").isin(1, 2)
    head = [
        F.when(refusing & (k % 19 == 0), F.lit(2)).otherwise(F.lit(1)).alias("schemaVersion"), F.concat(F.lit("r"), text(F.col("run"))).alias("runId"),
        F.lit("2026-02-03T00:00:00Z").alias("occurredAt"), F.lit("ad").alias("adapterId"), F.lit("1").alias("adapterVersion"),
    ]
    target = F.struct(
        F.lit("SUPPORTS").alias("type"), F.concat(F.lit("e"), text(m + 40)).alias("targetEventId"), F.when(m % 10 == 0, "r99").alias("targetRunId"))
    event = F.to_json(F.struct(
        F.lit("event").alias("recordKind"), *head, F.concat(F.lit("e"), text(m)).alias("eventId"), F.lit("CLAIM").alias("type"), F.struct(F.lit("p").alias("producer")).alias("origin"),
        F.struct(F.lit("s1").alias("sourceId"), F.lit("URL").alias("kind"), F.lit("https://x.example/").alias("location")).alias("source"), F.struct(F.lit("TRACE_REPORTED").alias("category")).alias("provenance"),
        F.struct(F.concat(F.lit("claim "), text(k % 2)).alias("text")).alias("payload"), F.array(target).alias("relations"),
    ))
    state = F.when(refusing & (k % 7 == 3), "LOST").when(k % 5 == 1, "COMPLETED").when(k % 5 == 3, "FAILED").otherwise("RUNNING")
    run = F.to_json(F.struct(F.lit("run").alias("recordKind"), *head, state.alias("lifecycle")))
    answer = F.to_json(F.struct(
        F.lit("answer").alias("recordKind"), *head, F.lit(1).alias("receiptVersion"), F.concat(F.lit("rc"), text(F.floor(eid / 12).cast("bigint"))).alias("receiptId"), F.lit("ag").alias("agentId"),
        F.concat(F.lit("an"), text(m)).alias("answerId"), F.concat(F.lit("answer "), text(k % 2)).alias("answer"), F.lit(True).alias("final"), F.lit("2026-02-03T00:00:00Z").alias("timestamp"),
    ))
    raw = F.when(eid % 3 == 0, event).when(eid % 3 == 1, run).otherwise(answer)
    lossy = F.col("file_no").isin(0, 1)
    raw = F.when(lossy & (k % 17 == 1), "").when(lossy & (k % 13 == 0), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    size = F.octet_length(raw).cast("bigint")
    return e.select(F.concat(F.lit("f"), text(F.col("file_no"))).alias("file"), eid.alias("line_no"), (eid * 1_000).alias("byte_offset"), size.alias("byte_length"), raw.alias("raw"), F.lit(True).alias("ended"))


_DONE: dict[tuple[str, str], Intake] = {}


def intake(s, d) -> Intake:
    """The chain, run once for a session and a data folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _DONE:
        _DONE[key] = ingest_lines(trace_lines(s, d), "TRACE_")
    return _DONE[key]


QUERIES = {
    "ing_from_lines": lambda s, d: intake(s, d).report,
    "ing_from_lines_counts": lambda s, d: intake(s, d).counts,
    "ing_from_lines_diagnostics": lambda s, d: intake(s, d).diagnostics,
    "ing_from_lines_losses": lambda s, d: intake(s, d).file_diagnostics,
    "ing_from_lines_completeness": lambda s, d: intake(s, d).completeness,
}

_LINES = """
WITH ev AS (SELECT event_id, event_id // 6 AS m, event_id // 6 % 40 AS run, event_id // 6 % 4 AS fno, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
ln AS (SELECT *, 'r' || run AS run_id, 'f' || fno AS file, fno < 2 AND k % 17 = 1 AS blank, fno < 2 AND k % 17 <> 1 AND k % 13 = 0 AS torn, fno IN (1, 2) AND k % 19 = 0 AS future,
       fno IN (1, 2) AND event_id % 3 = 1 AND k % 7 = 3 AS unknown, CASE event_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'run' ELSE 'answer' END AS kind,
       CASE event_id % 3 WHEN 0 THEN 'e' || m WHEN 1 THEN 'run@' || event_id ELSE 'rc' || (event_id // 12) END AS id, CASE WHEN k % 5 = 1 THEN 'COMPLETED' WHEN k % 5 = 3 THEN 'FAILED' ELSE 'RUNNING' END AS state FROM ev),
st AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS seq FROM ln WHERE NOT (blank OR torn OR future OR unknown)),
fi AS (SELECT *, first_value(k % 2) OVER w AS first_k, seq = min(seq) OVER (PARTITION BY run_id, kind, id) AS first FROM st WINDOW w AS (PARTITION BY run_id, kind, id ORDER BY seq)),
du AS (SELECT *, k % 2 = first_k AND kind <> 'run' AS same FROM fi WHERE NOT first),
rf AS (SELECT a.* FROM fi a WHERE a.kind = 'answer' AND a.first AND a.run % 2 = 1 AND EXISTS (SELECT 1 FROM fi b WHERE b.kind = 'answer' AND b.first AND b.id = a.id AND b.run = a.run - 1)),
ac AS (SELECT * FROM fi WHERE first AND (run_id, seq) NOT IN (SELECT run_id, seq FROM rf)),
te AS (SELECT run_id, min(seq) AS end_seq, arg_min(state, seq) AS end_state FROM st WHERE kind = 'run' AND state <> 'RUNNING' GROUP BY 1),
fd AS (SELECT file, event_id AS line_no, CASE WHEN torn THEN 'LOSS_MALFORMED_JSON' WHEN future THEN 'FUTURE_SCHEMA_VERSION' ELSE 'INVALID_FIELD' END AS code, 'error' AS severity FROM ln WHERE NOT blank AND (torn OR future OR unknown)
       UNION ALL SELECT file, event_id, 'INVALID_FIELD', 'error' FROM ln WHERE NOT blank AND NOT torn AND future AND unknown),
rj AS (SELECT file, count(*) AS n FROM ln WHERE NOT blank AND NOT torn AND (future OR unknown) GROUP BY 1),
rn AS (SELECT DISTINCT run_id, file FROM st),
bad AS (SELECT run_id FROM rn WHERE file IN (SELECT file FROM fd) UNION SELECT run_id FROM rf UNION SELECT run_id FROM du WHERE kind = 'answer' AND NOT same),
co AS (SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM bad) THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness FROM rn),
rl AS (SELECT run_id, id, seq, 'e' || (m + 40) AS target, m % 10 = 0 AS crossing FROM ac WHERE kind = 'event'),
dg AS (SELECT run_id, 'DUPLICATE_CONFLICTING' AS code, CASE kind WHEN 'answer' THEN 'error' ELSE 'warning' END AS severity, CASE kind WHEN 'event' THEN id END AS event_id, seq AS sequence FROM du WHERE NOT same
       UNION ALL SELECT run_id, 'RECEIPT_ID_CONFLICT', 'error', NULL, seq FROM rf
       UNION ALL SELECT st.run_id, 'RUN_TRANSITION_INVALID', 'warning', NULL, seq FROM st JOIN te USING (run_id) WHERE kind = 'run' AND seq > end_seq AND state <> end_state
       UNION ALL SELECT run_id, 'CROSS_RUN_RELATION', 'warning', id, seq FROM rl WHERE crossing
       UNION ALL SELECT run_id, 'DANGLING_RELATION', 'warning', id, seq FROM rl WHERE NOT crossing AND target NOT IN (SELECT id FROM ac a WHERE a.kind = 'event'))"""

ORACLES = {
    "ing_from_lines": f"""{_LINES}
       SELECT rn.run_id, coalesce(end_state, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.run_id = rn.run_id AND kind = 'run') THEN 'RUNNING' END, 'UNKNOWN') AS lifecycle, completeness,
         (SELECT count(*) FROM ac WHERE ac.run_id = rn.run_id AND kind = 'event') AS events_accepted, coalesce(n, 0) AS events_rejected, (SELECT count(*) FROM ac WHERE ac.run_id = rn.run_id) AS records_accepted,
         (SELECT count(*) FROM du WHERE du.run_id = rn.run_id AND same) AS duplicates_idempotent, (SELECT count(*) FROM du WHERE du.run_id = rn.run_id AND NOT same) AS duplicates_conflicting
       FROM rn JOIN co USING (run_id) LEFT JOIN te USING (run_id) LEFT JOIN rj USING (file)""",
    "ing_from_lines_completeness": f"{_LINES} SELECT * FROM co",
    "ing_from_lines_losses": f"{_LINES} SELECT * FROM fd",
    "ing_from_lines_diagnostics": f"{_LINES} SELECT * FROM dg",
    "ing_from_lines_counts": f"""{_LINES},
       pf AS (SELECT file, count(*) AS total, count(*) FILTER (code LIKE 'LOSS%') AS losses FROM fd GROUP BY 1),
       ow AS (SELECT run_id, count(*) AS total, count(*) FILTER (severity = 'error') AS errors FROM dg GROUP BY 1)
       SELECT run_id, coalesce(pf.total, 0) + coalesce(ow.total, 0) AS total, coalesce(pf.total, 0) + coalesce(ow.errors, 0) AS errors, coalesce(losses, 0) AS losses FROM rn LEFT JOIN pf USING (file) LEFT JOIN ow USING (run_id)""",
}
