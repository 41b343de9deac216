"""From lines of trace files to stored records, diagnostics and one report per run (SRC3, VAL3, ING1-ING5, ING8, ING9, ING11).

One scan of the lines feeds everything: what is lost or refused travels as rows beside the records. A loss or a refusal can't be blamed on one run,
so it counts for every run of its file; such counts are summed per file before they meet the runs, never written out per run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import content_hash
from ..operators import ingest as I
from ..operators.validate import validate_records
from ..runtime import stage
from ..sources.lines import scan_losses

_RELATIONS = "array<struct<type:string,targetEventId:string,targetRunId:string>>"


@dataclass(frozen=True)
class Intake:
    """What a set of trace files comes to.

    ``records`` are stored; ``file_diagnostics`` (file, line_no, code, severity) hold for every run of a file, ``diagnostics`` for their own.
    """

    records: DataFrame
    duplicates: DataFrame
    runs: DataFrame
    history: DataFrame
    completeness: DataFrame
    report: DataFrame
    file_diagnostics: DataFrame
    diagnostics: DataFrame
    counts: DataFrame


def trace_rows(valid: DataFrame) -> DataFrame:
    """Valid records as rows of identity, order, state and relations."""
    v = F.col("v")

    def text(path: str) -> Column:
        return F.try_variant_get(v, f"$.{path}", "string")

    kind = text("recordKind")
    targets = F.transform(F.try_variant_get(v, "$.relations", _RELATIONS), lambda r: F.struct(
        r["type"].alias("type"), r["targetEventId"].alias("target_event_id"), r["targetRunId"].alias("target_run_id")))
    return valid.select(
        text("runId").alias("run_id"), kind.alias("record_kind"), F.when(kind == "event", text("eventId")).when(kind == "answer", text("receiptId")).alias("record_id"),
        "file", "line_no", F.try_variant_get(v, "$.sequence", "bigint").alias("declared_sequence"), content_hash(F.col("body")).alias("content_hash"),
        F.when(kind == "run", text("lifecycle")).alias("lifecycle"), F.when(kind == "answer", text("answerId")).alias("answer_id"),
        F.when(kind == "event", targets).alias("relations"), "body",
    )


def ingest_lines(lines: DataFrame, prefix: str) -> Intake:
    """Ingest numbered lines (file, line_no, byte_offset, byte_length, raw, ended); ``prefix`` as in ``validate_records``."""
    # written once: records and losses both read the lines, and their filters would go below whatever spreads them
    good, losses, _ = scan_losses(stage(lines))
    valid, notes = validate_records(good.select("file", "line_no", "raw"), prefix)
    notes = stage(notes)
    losses = stage(losses)
    stamped, mismatches = I.stamp_sequence(stage(trace_rows(valid)))
    stamped = stage(stamped)
    accepted, duplicates, clashes = I.dedup_records(stamped)
    accepted, duplicates = stage(accepted), stage(duplicates)

    order = stamped.groupBy("run_id").agg(F.min(F.struct("file", "line_no")).alias("run_order"))
    answers = accepted.where("record_kind = 'answer'").withColumnRenamed("record_id", "receipt_id").join(order, "run_id")
    kept, refused = I.receipt_conflicts(answers.select("run_id", "receipt_id", "answer_id", "run_order", "sequence"))
    kept = kept.select("run_id", "sequence").withColumn("_kept", F.lit(True))
    records = stage(accepted.join(kept, ["run_id", "sequence"], "left").where("record_kind <> 'answer' OR _kept").drop("_kept"))

    runs, history, forbidden = I.fold_lifecycle(stamped.where("record_kind = 'run'").select("run_id", "sequence", "lifecycle"))
    refused_lines = notes.where("severity = 'error'").select("file", "line_no").distinct()
    unsafe = refused.select("run_id").union(clashes.where("severity = 'error'").select("run_id")).distinct()
    completeness = stage(I.batch_completeness(stamped, losses, refused_lines, unsafe))

    files = stamped.select("run_id", "file").distinct()
    rejected = refused_lines.groupBy("file").agg(F.count("*").alias("events_rejected"))
    by_run = files.join(rejected, "file").groupBy("run_id").agg(F.sum("events_rejected").alias("events_rejected"))
    report = I.ingest_report(records, duplicates, runs, completeness, by_run)

    events = records.where("record_kind = 'event'").select("run_id", F.col("record_id").alias("event_id"), "sequence", F.coalesce("relations", F.array()).alias("relations"))
    lost = losses.select("file", "line_no", F.concat(F.lit("LOSS_"), "code").alias("code"), F.lit("error").alias("severity"))
    file_diagnostics = lost.union(notes.where("severity = 'error'").select("file", "line_no", "code", "severity"))
    warned = notes.where("severity <> 'error'").join(refused_lines, ["file", "line_no"], "left_anti").join(stamped.select("file", "line_no", "run_id", "record_kind", "record_id", "sequence"), ["file", "line_no"])
    warned = warned.select("run_id", "code", "severity", F.when(F.col("record_kind") == "event", F.col("record_id")).alias("event_id"), "sequence")
    diagnostics = warned
    for more in (mismatches, clashes, refused, forbidden, I.relation_diagnostics(events)):
        diagnostics = diagnostics.unionByName(more)
    diagnostics = stage(diagnostics)
    return Intake(records, duplicates, runs, history, completeness, report, file_diagnostics, diagnostics, counted(files, file_diagnostics, diagnostics))


def counted(files: DataFrame, file_diagnostics: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row for each run of ``files`` (run_id, file): how many diagnostics, errors and losses hold for it."""
    error, loss = F.col("severity") == "error", F.startswith("code", F.lit("LOSS_"))
    per_file = file_diagnostics.groupBy("file").agg(F.count("*").alias("total"), F.count_if(error).alias("errors"), F.count_if(loss).alias("losses"))
    shared = files.join(per_file, "file", "left").select("run_id", "total", "errors", "losses")
    own = diagnostics.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(error).alias("errors"), F.lit(0).cast("bigint").alias("losses"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "errors", "losses")]
    return shared.union(own).groupBy("run_id").agg(*sums)
