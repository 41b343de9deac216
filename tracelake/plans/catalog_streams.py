"""Registered batch twins of the streams (STR4, STR6) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental, live
from . import bind
from .catalog_ingest import stamped
from .silver import silver


def partial_records(s, d):
    """Records of which runs with an even last digit lost every fiftieth."""
    even = F.substring("run_id", -1, 1).isin(*"02468")
    return stamped(s, d).where(~(even & (F.col("sequence") % 50 == 49)))


def invalidations(s, d):
    """Trace events in batches of twenty of a run; the first answer of a run is told of its shared events at batch 1."""
    events = silver(s, d, "trace_events", lambda: bind.trace_events(s, d)).withColumn("batch", F.floor((F.col("sequence") - 1) / 20).cast("int"))
    answers, scope = bind.trace_answers(events)
    scope = scope.withColumn("from_batch", F.when((F.col("scope") == "shared") & F.endswith("receipt_id", F.lit("-0")), 1).otherwise(0))
    return incremental.invalidation_log(events, answers, scope)


QUERIES = {
    "str_run_progress": lambda s, d: live.run_progress(partial_records(s, d)),
    "str_invalidations": invalidations,
}

ORACLES = {
    "str_run_progress": f"""WITH {bind.RECORDS_SQL},
       pl AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS place FROM rc WHERE NOT (right(run_id, 1) IN ('0', '2', '4', '6', '8') AND sequence % 50 = 49)),
       ap AS (SELECT *, last_value(CASE WHEN lifecycle <> 'CREATED' THEN lifecycle END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM pl WHERE sequence = place AND record_kind = 'run'),
       te AS (SELECT run_id, arg_min(lifecycle, sequence) AS final FROM ap WHERE lifecycle IN ('COMPLETED', 'FAILED', 'CANCELLED') GROUP BY 1),
       li AS (SELECT run_id, arg_max(lifecycle, sequence) FILTER (NOT (lifecycle = 'CREATED' AND coalesce(before, '') = 'RUNNING')) AS now FROM ap GROUP BY 1),
       co AS (SELECT run_id, count(*) FILTER (sequence = place AND record_kind = 'event') AS events, count(*) FILTER (sequence = place) AS applied, count(*) FILTER (sequence <> place) AS pending FROM pl GROUP BY 1)
       SELECT run_id, coalesce(final, now, 'UNKNOWN') AS lifecycle, events, applied, pending, final IS NOT NULL AS terminal, final IS NOT NULL AND pending = 0 AS finalized FROM co LEFT JOIN te USING (run_id) LEFT JOIN li USING (run_id)""",
    "str_invalidations": f"""WITH {bind.TRACE_SQL},
       e AS (SELECT run_id, event_id, sequence, (sequence - 1) // 20 AS batch, rel_target, rel_run, ((sequence - 1) // 8) % 3 AS part FROM te),
       h AS (SELECT aid, declared, e.*, CASE WHEN declared AND part = 2 AND aid LIKE '%-0' THEN 1 ELSE 0 END AS fb FROM tq JOIN e USING (run_id) WHERE NOT declared OR part = 2 OR aid = run_id || '-' || part)
       SELECT batch, aid, 'NEW_INPUT' AS cause, event_id AS input_id, NULL AS invalidated_id FROM h WHERE fb <= batch
       UNION ALL SELECT DISTINCT t.batch, t.aid, 'LATE_REFERENCE', t.event_id, x.event_id FROM h x JOIN h t ON t.aid = x.aid AND t.run_id = x.run_id AND t.event_id = x.rel_target
         WHERE coalesce(x.rel_run, x.run_id) = x.run_id AND (x.batch < t.batch OR (x.batch = t.batch AND x.sequence < t.sequence)) AND x.fb <= t.batch AND t.fb <= t.batch
       UNION ALL SELECT DISTINCT 1, aid, 'ANSWER_SCOPE_CHANGE', aid, NULL FROM h WHERE fb = 1 AND (SELECT max(batch) FROM e) >= 1""",
}
