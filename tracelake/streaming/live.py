"""Streaming twins of the batch operators, and signatures of what reports were computed from.

The file source reads closed files, so producers roll their spool files; the checkpoint is the cursor
that never splits a line. Keyed state ends ``ttl_ms`` after its key was last seen, where that is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import agg_set_lanes
from ..operators.ingest import TERMINAL, fold_lifecycle
from ..operators.ordered import ordered_scan, running_sum, sequence_chunk
from ..runtime import stage


def read_spool(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of rolled spool files as they appear, each once."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(path)
        .select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("file_time"))
    )


def _timeout(ttl_ms: int | None) -> str:
    """State that is not touched for ``ttl_ms`` of processing time ends; without a limit it stays."""
    return GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _expiring(step, ttl_ms: int | None, names: list[str], ints: set[str]):
    """``step`` for keys with rows; a key whose time is over loses its state and gives no row."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield _frame([], names, ints)
            return
        yield from step(key, batches, state)
        if ttl_ms is not None and state.exists:
            state.setTimeoutDuration(ttl_ms)

    return run


_DEDUP = "run_id string, record_kind string, record_id string, sequence bigint, content_hash string, verdict string, first_sequence bigint"


_DEDUP_NAMES = ["run_id", "record_kind", "record_id", "sequence", "content_hash", "verdict", "first_sequence"], {"sequence", "first_sequence"}


def _first_hash(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = []
    known = state.get if state.exists else None
    merged = pd.concat(list(batches))
    for sequence, digest in sorted(zip(merged["sequence"], merged["content_hash"], strict=True)):
        if known is None:
            known = (digest, int(sequence))
            verdict = "ACCEPTED"
        else:
            verdict = "IDEMPOTENT" if known[0] == digest else "CONFLICTING"
        rows.append((*key, int(sequence), digest, verdict, known[1]))
    state.update(known)
    yield _frame(rows, *_DEDUP_NAMES)


def _frame(rows: list[tuple], names: list[str], ints: set[str]) -> pd.DataFrame:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pd.DataFrame({n: pd.Series(list(c), dtype="int64" if n in ints else object) for n, c in zip(names, cols, strict=True)})


def dedup_stream(records: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Each record with its verdict: ACCEPTED, IDEMPOTENT or CONFLICTING against the first of its id.

    The state of an id is its first hash and sequence; an id that is not seen for ``ttl_ms`` is forgotten, and is new when it comes again. Copies inside one micro-batch that do not
    change the verdict of others are folded before the shuffle by ``dropDuplicates`` upstream.
    """
    return records.select("run_id", "record_kind", "record_id", "sequence", "content_hash").groupBy("run_id", "record_kind", "record_id").applyInPandasWithState(
        _expiring(_first_hash, ttl_ms, *_DEDUP_NAMES), _DEDUP, "digest string, first bigint", "append", _timeout(ttl_ms)
    )


def run_progress(records: DataFrame) -> DataFrame:
    """One row for each run (run_id, lifecycle, events, applied, pending, terminal, finalized), from records in any order.

    Records count up to the first sequence that is missing; those after it are pending. A run is final when it has ended and nothing is pending.
    """
    rows = records.select("run_id", "sequence", "record_kind", "lifecycle").dropDuplicates(["run_id", "sequence"])
    placed = stage(ordered_scan(rows, ["run_id"], ["sequence"], sequence_chunk(), place=running_sum(F.lit(1))))
    applied = placed.where("sequence = place")
    states, _, _ = fold_lifecycle(applied.where("record_kind = 'run'").select("run_id", "sequence", "lifecycle"))
    counts = placed.groupBy("run_id").agg(
        F.count_if((F.col("sequence") == F.col("place")) & (F.col("record_kind") == "event")).alias("events"), F.count_if(F.col("sequence") == F.col("place")).alias("applied"), F.count("*").alias("all"))
    out = counts.join(states.select("run_id", "lifecycle"), "run_id", "left").withColumns({"lifecycle": F.coalesce("lifecycle", F.lit("UNKNOWN")), "pending": F.col("all") - F.col("applied")})
    terminal = F.col("lifecycle").isin(*TERMINAL)
    return out.select("run_id", "lifecycle", "events", "applied", "pending", terminal.alias("terminal"), (terminal & (F.col("pending") == 0)).alias("finalized"))


_PROGRESS_NAMES = ["run_id", "lifecycle", "events", "applied", "pending", "terminal", "finalized"], {"events", "applied", "pending"}


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lifecycle, busy, events, applied, waiting = state.get if state.exists else ("UNKNOWN", False, 0, 0, [])
    held = {int(w["sequence"]): (w["kind"], w["lifecycle"]) for w in (r if isinstance(r, dict) else r.asDict() for r in waiting)}
    for pdf in batches:
        for r in pdf.to_dict("records"):
            if r["sequence"] > applied:
                held.setdefault(int(r["sequence"]), (r["record_kind"], r["lifecycle"]))
    while applied + 1 in held:
        kind, now = held.pop(applied + 1)
        applied += 1
        events += kind == "event"
        if kind == "run" and (now == lifecycle or lifecycle not in TERMINAL) and not (now == "CREATED" and busy):
            lifecycle = now
        if kind == "run" and now != "CREATED":
            busy = now == "RUNNING"
    state.update((lifecycle, bool(busy), int(events), int(applied), [{"sequence": q, "kind": k, "lifecycle": c} for q, (k, c) in sorted(held.items())]))
    done = lifecycle in TERMINAL
    yield _frame([(key[0], lifecycle, events, applied, len(held), done, done and not held)], *_PROGRESS_NAMES)


def run_progress_stream(records: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Live twin of ``run_progress`` in update mode: the state of a run is its counts and the records that wait for a missing one."""
    return records.select("run_id", "sequence", "record_kind", "lifecycle").groupBy("run_id").applyInPandasWithState(
        _expiring(_advance, ttl_ms, *_PROGRESS_NAMES), "run_id string, lifecycle string, events bigint, applied bigint, pending bigint, terminal boolean, finalized boolean",
        "lifecycle string, busy boolean, events bigint, applied bigint, waiting array<struct<sequence:bigint,kind:string,lifecycle:string>>", "update", _timeout(ttl_ms),
    )


def _warn_once(threshold: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, start = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            if r["event_type"] == "verification":
                if r["verification_kind"] not in (None, "other"):
                    seen, start = [], None
            elif r["fingerprint_basis"] == "content" and r["change_hash"] is not None and len(seen) < threshold and r["change_hash"] not in seen:
                start = start or r["change_hash"]
                seen.append(r["change_hash"])
                if len(seen) == threshold:
                    rows.append((key[0], int(r["seq"]), threshold, start))
        state.update((seen, start))
        yield _frame(rows, ["session_id", "seq", "distinct_edits", "episode_start"], {"seq", "distinct_edits"})

    return step


def verify_first_stream(events: DataFrame, threshold: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """One warning per episode, at the event that brings the distinct fingerprints to the threshold.

    The state of a session holds at most ``threshold`` fingerprints and ends ``ttl_ms`` after its last event.
    """
    names = ["session_id", "seq", "distinct_edits", "episode_start"], {"seq", "distinct_edits"}
    work = events.where(F.col("event_type").isin("implementation", "verification")).select("session_id", "seq", "event_type", "verification_kind", "fingerprint_basis", "change_hash")
    return work.groupBy("session_id").applyInPandasWithState(
        _expiring(_warn_once(threshold), ttl_ms, *names), "session_id string, seq bigint, distinct_edits bigint, episode_start string", "seen array<string>, start string", "append", _timeout(ttl_ms)
    )


def _count_batches(threshold: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the last batch may not be over: it is kept apart from what came before it
        count, fired, last, check, impl = state.get if state.exists else (0, False, None, False, False)
        found: dict[int, list[bool]] = {} if last is None else {int(last): [bool(check), bool(impl)]}
        for pdf in batches:
            checks = (pdf["event_type"] == "verification") & pdf["verification_kind"].notna() & (pdf["verification_kind"] != "other")
            changes = (pdf["event_type"] == "implementation") & ~pdf["test_only"].fillna(False).astype(bool)
            for number, c, i in zip(pdf["batch_id"], checks, changes, strict=True):
                flags = found.setdefault(int(number), [False, False])
                flags[0], flags[1] = flags[0] or bool(c), flags[1] or bool(i)
        rows, before = [], (count, fired)
        for number in sorted(found):
            before = (count, fired)
            if found[number][0]:
                count, fired = 0, False
            elif found[number][1]:
                count += 1
            if count >= threshold and not fired:
                rows, fired = [*rows, (key[0], count)], True
        last = max(found)
        # a warning of the unfinished batch was given, so it is not given again
        state.update((int(before[0]), bool(fired), last, *found[last]))
        yield _frame(rows, ["session_id", "opportunities"], {"opportunities"})

    return step


def opportunities_stream(events: DataFrame, threshold: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """Warn when ``threshold`` batches in a row (by ``batch_id``, in ascending order) changed code and verified nothing."""
    work = events.where(F.col("event_type").isin("implementation", "verification")).select("session_id", "batch_id", "event_type", "verification_kind", "test_only")
    return work.groupBy("session_id").applyInPandasWithState(
        _expiring(_count_batches(threshold), ttl_ms, ["session_id", "opportunities"], {"opportunities"}), "session_id string, opportunities bigint",
        "n bigint, fired boolean, last bigint, checked boolean, changed boolean", "append", _timeout(ttl_ms),
    )


def _on_change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, same = state.get if state.exists else (None, 0)
    rows = []
    for r in pd.concat(list(batches)).sort_values("poll").to_dict("records"):
        status = f"{r['lifecycle']}|{r['events']}"
        same = same + 1 if status == last else 0
        stable = r["lifecycle"] in TERMINAL and same >= 2
        if status != last or (stable and same == 2):
            rows.append((key[0], int(r["poll"]), r["lifecycle"], int(r["events"]), bool(stable)))
        last = status
    state.update((last, int(same)))
    yield _frame(rows, ["run_id", "poll", "lifecycle", "events", "stable"], {"poll", "events"})


def monitor(polls: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Status rows only when something changed; stable after two equal polls of a finished run. A run not polled for ``ttl_ms`` is forgotten."""
    return polls.groupBy("run_id").applyInPandasWithState(
        _expiring(_on_change, ttl_ms, ["run_id", "poll", "lifecycle", "events", "stable"], {"poll", "events"}), "run_id string, poll bigint, lifecycle string, events bigint, stable boolean",
        "status string, same bigint", "append", _timeout(ttl_ms),
    )


def source_resets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that shrank, were replaced, or vanished between two listings (path, length, modified_ms)."""
    old = before.select("path", F.col("length").alias("_len"), F.col("modified_ms").alias("_ms"))
    both = old.join(after, "path", "left")
    kind = (
        F.when(F.col("length").isNull(), "SOURCE_MISSING").when(F.col("length") < F.col("_len"), "SOURCE_TRUNCATED")
        .when((F.col("length") == F.col("_len")) & (F.col("modified_ms") > F.col("_ms")), "SOURCE_REPLACED")
    )
    return both.select("path", kind.alias("code")).where("code is not null")


def signatures(scoped: DataFrame, answers: DataFrame, analyzer_version: str) -> DataFrame:
    """What a report was computed from: events, highest sequence, which events, completeness, analyzer version."""
    extent = scoped.groupBy("aid").agg(F.count("*").alias("events"), F.max("sequence").alias("max_sequence"), *agg_set_lanes(F.col("event_id")))
    scope = F.sha2(F.concat_ws("\n", *[F.col(f"_lane{i}").cast("string") for i in range(4)]), 256)
    return answers.select(F.col("receipt_id").alias("aid"), "completeness").join(extent, "aid", "left").select(
        "aid", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("max_sequence", F.lit(0)).alias("max_sequence"), scope.alias("scope"), "completeness", F.lit(analyzer_version).alias("analyzer_version")
    )


def freshness_of(stored: DataFrame, current: DataFrame) -> DataFrame:
    """CURRENT, STALE with reasons, or MISSING per answer."""
    fields = {"events": "EVENT_COUNT", "max_sequence": "MAX_SEQUENCE", "scope": "SCOPE", "completeness": "COMPLETENESS", "analyzer_version": "ANALYZER"}
    old = stored.select("aid", F.struct(*fields).alias("_old"))
    reasons = F.array_join(F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_old.{c}")), r) for c, r in fields.items()]), lambda x: x.isNotNull()), ",")
    return current.join(old, "aid", "left").select(
        "aid", F.when(F.col("_old").isNull(), "MISSING").when(reasons == "", "CURRENT").otherwise("STALE").alias("status"), F.when(F.col("_old").isNotNull(), reasons).alias("reasons")
    )
