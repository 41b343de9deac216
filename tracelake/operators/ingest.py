"""Trace ingest: reception order, duplicates, lifecycle, completeness, relations, reports.

Records: ``run_id, record_kind (event, run, answer), record_id, file, line_no, content_hash`` and
whatever else the caller carries. Events with relations: ``trace_events`` as bound or validated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from .ordered import fold_groups, last_seen, ordered_scan, running_sum, sequence_chunk

RECORD = ["run_id", "record_kind", "record_id"]
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
DIAGNOSTIC = ["run_id", "code", "severity", "event_id", "sequence"]


def diagnostic(df: DataFrame, code: str, severity: str, event_id="event_id") -> DataFrame:
    eid = F.col(event_id) if event_id in df.columns else F.lit(None).cast("string")
    return df.select("run_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), eid.alias("event_id"), F.col("sequence").cast("bigint").alias("sequence"))


def stamp_sequence(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reception sequence per run, duplicates included; a declared sequence that differs is reported."""
    stamped = ordered_scan(
        records, ["run_id"], ["file", "line_no"], F.struct("file", F.floor(F.col("line_no") / 65_536).alias("part")), sequence=running_sum(F.lit(1))
    )
    event_id = F.when(F.col("record_kind") == "event", F.col("record_id"))
    wrong = stamped.where(F.col("declared_sequence") != F.col("sequence")).withColumn("event_id", event_id)
    return stamped, diagnostic(wrong, "SEQUENCE_MISMATCH", "warning")


def dedup_records(stamped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First record per (run, kind, id); later ones are IDEMPOTENT or CONFLICTING duplicates.

    The first record is found by a partial aggregate and joined back, so an id with very many copies
    is not gathered in one task.
    """
    named = stamped.withColumn(
        "record_id", F.when(F.col("record_kind") == "run", F.concat(F.lit("run@"), F.col("sequence").cast("string"))).otherwise(F.col("record_id"))
    )
    first = named.groupBy(*RECORD).agg(F.min(F.struct("sequence", "content_hash")).alias("_first"))
    marked = named.join(first, RECORD)
    accepted = marked.where(F.col("sequence") == F.col("_first.sequence")).drop("_first")
    again = marked.where(F.col("sequence") > F.col("_first.sequence"))
    duplicates = again.select(
        *RECORD,
        F.when(F.col("content_hash") == F.col("_first.content_hash"), "IDEMPOTENT").otherwise("CONFLICTING").alias("duplicate_kind"),
        F.col("_first.sequence").alias("first_sequence"),
        F.col("sequence").alias("duplicate_sequence"),
    )
    clash = duplicates.where("duplicate_kind = 'CONFLICTING'").select(
        "run_id",
        F.lit("DUPLICATE_CONFLICTING").alias("code"),
        F.when(F.col("record_kind") == "answer", "error").otherwise("warning").alias("severity"),
        F.when(F.col("record_kind") == "event", F.col("record_id")).alias("event_id"),
        F.col("duplicate_sequence").alias("sequence"),
    )
    return accepted, duplicates, clash


def receipt_conflicts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers whose receipt id and (run, answer id) are both still free, in (run_order, sequence).

    A rejected answer claims nothing. Each round settles the answers that are first for both of their
    identities and drops those that clash with them, which gives the same set as one by one.
    """
    order = F.struct("run_order", "sequence", "receipt_id")
    open_rows = stage(answers.select("receipt_id", "run_id", "answer_id", "run_order", "sequence"))
    settled = None
    while True:
        by_receipt = open_rows.groupBy("receipt_id").agg(F.min(order).alias("_r"))
        by_answer = open_rows.groupBy("run_id", "answer_id").agg(F.min(order).alias("_a"))
        first = stage(
            open_rows.join(by_receipt, "receipt_id").join(by_answer, ["run_id", "answer_id"])
            .where((F.col("_r") == order) & (F.col("_a") == order))
            .select("receipt_id", "run_id", "answer_id", "sequence")
        )
        settled = first if settled is None else settled.unionByName(first)
        open_rows = stage(
            open_rows.join(first.select("receipt_id"), "receipt_id", "left_anti")
            .join(first.select("run_id", "answer_id"), ["run_id", "answer_id"], "left_anti")
        )
        if open_rows.isEmpty():
            break
    key = ["receipt_id", "run_id", "answer_id", "sequence"]
    accepted = answers.join(settled.select(*key), key, "left_semi")
    refused = answers.join(settled.select(*key), key, "left_anti")
    return accepted, diagnostic(refused, "RECEIPT_ID_CONFLICT", "error")


def lifecycle_steps(run_records: DataFrame) -> DataFrame:
    """Each lifecycle observation with whether its transition is allowed.

    The table of transitions comes down to two rules, so no automaton is folded: after the first
    terminal state only the same state may follow, and CREATED may not follow RUNNING.
    """
    seen = ordered_scan(
        run_records, ["run_id"], ["sequence"], sequence_chunk(),
        _busy=last_seen(F.col("lifecycle"), F.col("lifecycle") != "CREATED"),
    )
    end = run_records.where(F.col("lifecycle").isin(*TERMINAL)).groupBy("run_id").agg(F.min(F.struct("sequence", "lifecycle")).alias("_end"))
    late = F.coalesce(F.col("sequence") > F.col("_end.sequence"), F.lit(False))
    allowed = F.when(late, F.col("lifecycle") == F.col("_end.lifecycle")).otherwise(
        ~((F.col("lifecycle") == "CREATED") & F.coalesce(F.col("_busy") == "RUNNING", F.lit(False)))
    )
    return seen.join(end, "run_id", "left").withColumn("allowed", allowed).drop("_busy", "_end")


def fold_lifecycle(run_records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run state, the accepted transitions, and a diagnostic per forbidden one."""
    steps = lifecycle_steps(run_records)
    runs = steps.groupBy("run_id").agg(
        F.coalesce(F.max_by("lifecycle", F.when(F.col("allowed"), F.col("sequence"))), F.lit("UNKNOWN")).alias("lifecycle"),
        F.count_if("allowed").alias("transitions"),
        F.max(F.when(F.col("allowed"), F.col("sequence"))).alias("last_transition"),
    )
    history = steps.where("allowed").select("run_id", "sequence", "lifecycle")
    return runs, history, diagnostic(steps.where("not allowed"), "RUN_TRANSITION_INVALID", "warning")


def batch_completeness(records: DataFrame, losses: DataFrame, rejects: DataFrame, receipt_errors: DataFrame) -> DataFrame:
    """Any loss or reject makes every run of its file PARTIAL; a receipt conflict its own run."""
    bad_files = losses.select("file").union(rejects.select("file")).distinct()
    bad_runs = (
        records.select("run_id", "file").distinct().join(bad_files, "file", "left_semi").select("run_id")
        .union(receipt_errors.select("run_id"))
        .distinct()
        .withColumn("completeness", F.lit("PARTIAL"))
    )
    return records.select("run_id").distinct().join(bad_runs, "run_id", "left").withColumn(
        "completeness", F.coalesce("completeness", F.lit("COMPLETE"))
    )


#: Codes of what the line scan and the source watch lose.
LOSS_CODES = ("MALFORMED_JSON", "INVALID_UTF8", "TRUNCATED_TAIL", "OVERSIZED_LINE", "SOURCE_TRUNCATED", "SOURCE_REPLACED", "SOURCE_MISSING")


def live_completeness(run_records: DataFrame, diagnostics: DataFrame, drained: DataFrame) -> DataFrame:
    """UNKNOWN until a terminal record arrived and the run is in ``drained`` (run_id); then PARTIAL when anything was lost, else COMPLETE."""
    ended = run_records.groupBy("run_id").agg(F.bool_or(F.col("lifecycle").isin(*TERMINAL)).alias("terminal"))
    bad = diagnostics.where((F.col("severity") == "error") | F.col("code").isin(*LOSS_CODES)).groupBy("run_id").agg(F.count("*").alias("_bad"))
    through = drained.select("run_id").distinct().withColumn("_drained", F.lit(True))
    closed = F.col("terminal") & F.coalesce("_drained", F.lit(False))
    return ended.join(bad, "run_id", "left").join(through, "run_id", "left").select(
        "run_id",
        "terminal",
        F.when(~F.coalesce(closed, F.lit(False)), "UNKNOWN").when(F.coalesce("_bad", F.lit(0)) > 0, "PARTIAL").otherwise("COMPLETE").alias("completeness"),
    )


def reject_foreign(records: DataFrame, expected_run: str) -> tuple[DataFrame, DataFrame]:
    foreign = records.where(F.col("run_id") != expected_run)
    event_id = F.when(F.col("record_kind") == "event", F.col("record_id"))
    return records.where(F.col("run_id") == expected_run), diagnostic(
        foreign.withColumn("event_id", event_id), "RUN_ID_MISMATCH", "error"
    )


def relation_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "run_id", "event_id", "sequence", F.inline("relations")
    ).withColumnRenamed("type", "relation")


def _back_edges(key: tuple, rows: list[dict]) -> list[tuple]:
    """Edges of one stretch that step forward and lie on a cycle: both ends are in one strongly connected component."""
    targets: dict[str, list[str]] = {}
    for r in rows:
        targets.setdefault(r["event_id"], []).append(r["target_event_id"])
    index, low, component, held = {}, {}, {}, []
    for start in targets:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        held.append(start)
        path = [(start, iter(targets[start]))]
        while path:
            node, rest = path[-1]
            for target in rest:
                if target not in index:
                    index[target] = low[target] = len(index)
                    held.append(target)
                    path.append((target, iter(targets.get(target, ()))))
                    break
                if target not in component:
                    low[node] = min(low[node], index[target])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    while node not in component:
                        component[held.pop()] = index[node]
    return [
        (key[0], r["event_id"], int(r["sequence"]), r["target_event_id"])
        for r in rows
        if r["target_sequence"] > r["sequence"] and component[r["event_id"]] == component[r["target_event_id"]]
    ]


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Every relation that closes a cycle: run_id, event_id, sequence, target_event_id. ``edges`` also have target_sequence.

    Of the relations on a cycle, those that point to a later event or to their own event close it.

    A cycle must step forward in the sequence somewhere, and its whole span is covered by forward
    edges. Relations normally point backward, so only edges inside a stretch covered by forward edges
    can matter, and only those few are searched, one stretch at a time.
    """
    edges = stage(edges)
    loops = edges.where("target_sequence = sequence").select("run_id", "event_id", "sequence", "target_event_id")
    edges = edges.where("target_sequence <> sequence")
    forward = edges.where("target_sequence > sequence")
    moves = forward.select(
        "run_id",
        F.inline(F.array(
            F.struct(F.col("sequence").alias("at"), F.lit(0).alias("pass"), F.lit(1).alias("move")),
            F.struct(F.col("target_sequence").alias("at"), F.lit(2).alias("pass"), F.lit(-1).alias("move")),
        )),
    ).groupBy("run_id", "at", "pass").agg(F.sum("move").alias("move"))
    marks = edges.select("run_id", F.col("sequence").alias("at"), F.lit(1).alias("pass"), F.lit(0).cast("bigint").alias("move")).distinct()
    walked = ordered_scan(
        moves.unionByName(marks), ["run_id"], ["at", "pass"], sequence_chunk("at"),
        depth=running_sum(F.col("move")), shut=running_sum(F.when(F.col("pass") == 2, -F.col("move")).otherwise(0), inclusive=False),
    )
    # The stretch number is the count of spans closed when the depth was last zero.
    opened = ordered_scan(
        walked.withColumn("_start", (F.col("pass") == 0) & (F.col("depth") == F.col("move"))),
        ["run_id"], ["at", "pass"], sequence_chunk("at"), stretch=running_sum(F.col("_start").cast("int")),
    )
    inside = opened.where("pass = 1 and depth > 0").select("run_id", F.col("at").alias("sequence"), "stretch")
    target = inside.select("run_id", F.col("sequence").alias("target_sequence"), F.col("stretch").alias("_target_stretch"))
    core = edges.join(inside, ["run_id", "sequence"]).join(target, ["run_id", "target_sequence"]).where("stretch = _target_stretch")
    rows = core.select("run_id", "stretch", "event_id", "sequence", "target_event_id", "target_sequence")
    found = fold_groups(rows, ["run_id", "stretch"], ["sequence"], _back_edges, "run_id string, event_id string, sequence bigint, target_event_id string")
    return found.unionByName(loops)


def relation_diagnostics(events: DataFrame) -> DataFrame:
    """CROSS_RUN, DANGLING and CYCLE relations; nothing is dropped or guessed."""
    rel = relation_rows(events)
    cross = F.col("target_run_id").isNotNull() & (F.col("target_run_id") != F.col("run_id"))
    known = events.select("run_id", F.col("event_id").alias("target_event_id"), F.col("sequence").alias("target_sequence"))
    local = rel.where(~cross).join(known, ["run_id", "target_event_id"], "left")
    dangling = local.where("target_sequence is null")
    cycles = cycle_edges(local.where("target_sequence is not null").select("run_id", "event_id", "sequence", "target_event_id", "target_sequence"))
    return (
        diagnostic(rel.where(cross), "CROSS_RUN_RELATION", "warning")
        .unionByName(diagnostic(dangling, "DANGLING_RELATION", "warning"))
        .unionByName(diagnostic(cycles, "CYCLE_RELATION", "warning"))
    )


def ingest_report(accepted: DataFrame, duplicates: DataFrame, runs: DataFrame, completeness: DataFrame, rejected_by_run: DataFrame | None = None) -> DataFrame:
    """One row per run."""
    counts = accepted.groupBy("run_id").agg(
        F.count_if(F.col("record_kind") == "event").alias("events_accepted"), F.count("*").alias("records_accepted")
    )
    twice = duplicates.groupBy("run_id").agg(
        F.count_if(F.col("duplicate_kind") == "IDEMPOTENT").alias("duplicates_idempotent"),
        F.count_if(F.col("duplicate_kind") == "CONFLICTING").alias("duplicates_conflicting"),
    )
    out = counts.join(twice, "run_id", "left").join(runs.select("run_id", "lifecycle"), "run_id", "left").join(completeness.select("run_id", "completeness"), "run_id", "left")
    if rejected_by_run is not None:
        out = out.join(rejected_by_run, "run_id", "left")
    else:
        out = out.withColumn("events_rejected", F.lit(0))
    return out.select(
        "run_id",
        F.coalesce("lifecycle", F.lit("UNKNOWN")).alias("lifecycle"),
        F.coalesce("completeness", F.lit("UNKNOWN")).alias("completeness"),
        "events_accepted",
        F.coalesce("events_rejected", F.lit(0)).alias("events_rejected"),
        "records_accepted",
        F.coalesce("duplicates_idempotent", F.lit(0)).alias("duplicates_idempotent"),
        F.coalesce("duplicates_conflicting", F.lit(0)).alias("duplicates_conflicting"),
    )


def same_loads(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: records of the first load, and whether both have the same rows, by an order-free digest of each."""
    def digest(df: DataFrame) -> DataFrame:
        return df.select(*a.columns).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*a.columns).cast("decimal(38,0)")).alias("sum"))

    both = digest(a).withColumn("load", F.lit(0)).union(digest(b).withColumn("load", F.lit(1)))
    same = (F.min("n") == F.max("n")) & F.coalesce(F.min("sum") == F.max("sum"), F.min("n") == 0)
    return both.agg(F.min_by("n", "load").alias("records"), same.alias("same"))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("code").isin("MALFORMED_JSON", "INVALID_UTF8", "TRUNCATED_TAIL", "OVERSIZED_LINE")).alias("losses"),
    )


def newest_diagnostics(diagnostics: DataFrame, run_id: str, limit: int = 100) -> DataFrame:
    return diagnostics.where(F.col("run_id") == run_id).orderBy(F.col("sequence").desc(), "code", "event_id").limit(limit)


def run_report(runs: DataFrame, history: DataFrame, keeps: DataFrame, diagnostics: DataFrame, last: int = 100) -> tuple[DataFrame, DataFrame]:
    """One row per run, and its last ``last`` transitions as rows."""
    counts = diagnostics.groupBy("run_id").agg(F.count("*").alias("diagnostics"))
    kept = keeps.select("run_id").distinct().withColumn("kept", F.lit(True))
    row = runs.join(counts, "run_id", "left").join(kept, "run_id", "left").withColumns(
        {"diagnostics": F.coalesce("diagnostics", F.lit(0)), "kept": F.coalesce("kept", F.lit(False))}
    )
    row = row.withColumn(
        "revision",
        F.sha2(F.to_json(F.struct("completeness", "diagnostics", "kept", "lifecycle", "run_id", "transitions")), 256)
        if "completeness" in row.columns
        else F.sha2(F.to_json(F.struct("diagnostics", "kept", "lifecycle", "run_id", "transitions")), 256),
    )
    numbered = ordered_scan(history, ["run_id"], ["sequence"], sequence_chunk(), step=running_sum(F.lit(1)))
    recent = numbered.join(runs.select("run_id", "transitions"), "run_id").where(F.col("step") > F.col("transitions") - last)
    return row, recent.select("run_id", "step", "sequence", "lifecycle")
