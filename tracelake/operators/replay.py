"""Replay operators: attempts, verification debt, dead ends, progress, and facts of a session.

Input: one row per replay event (``tracelake.schemas.REPLAY_EVENT``), ordered by ``seq`` in a session.
Lists that grow with a session (verifications of an attempt, turns, outcomes) stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import agg_set_lanes
from ..runtime import stage
from .ordered import last_seen, ordered_scan, running_sum, sequence_chunk, trailing

ATTEMPT = ["session_id", "attempt_no"]


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def segment(events: DataFrame, whole: bool = False) -> DataFrame:
    """Implementation and verification events with the attempt they belong to.

    A new attempt starts at an implementation that follows a verification; verifications before the
    first implementation belong to none and are dropped. ``whole`` says that all lie in one chunk (``one_chunk``):
    then both scans run over one shuffle.
    """
    work = events.where(F.col("event_type").isin("implementation", "verification")).withColumn("_slice", sequence_chunk("seq"))
    seen = ordered_scan(work, ["session_id"], ["seq"], "_slice", whole, _before=last_seen(F.col("event_type")))
    seen = seen if whole else stage(seen)
    start = _is("implementation") & (F.col("_before").isNull() | (F.col("_before") == "verification"))
    return (
        ordered_scan(seen, ["session_id"], ["seq"], "_slice", whole, attempt_no=running_sum(start.cast("int")))
        .where("attempt_no > 0")
        .drop("_before", "_slice")
    )


def change_sets(segmented: DataFrame) -> DataFrame:
    """Number and hash of the distinct change hashes of each attempt.

    The hash comes from order-free sums over the set, so no set is ever gathered.
    """
    distinct = segmented.where(_is("implementation") & F.col("change_hash").isNotNull()).select(*ATTEMPT, "change_hash").distinct()
    size = distinct.groupBy(*ATTEMPT).agg(F.count("*").alias("changed_files"), *agg_set_lanes(F.col("change_hash")))
    lanes = F.concat_ws("\n", F.lit("set"), *[F.col(f"_lane{i}").cast("string") for i in range(4)])
    return size.select(*ATTEMPT, "changed_files", F.substring(F.sha2(lanes, 256), 1, 32).alias("change_hash"))


def attempts(segmented: DataFrame) -> DataFrame:
    """One row per attempt."""
    impl, check = _is("implementation"), _is("verification")
    kind, ok = F.col("verification_kind"), F.col("ok")

    def last(value, where):
        return F.max_by(value, F.when(where, F.col("seq")))

    build = last(F.struct(ok), check & (kind == "build"))["ok"]
    had_build = F.bool_or(check & (kind == "build"))
    test = last(F.struct(ok, "tests_failed"), check & (kind == "test"))
    grouped = segmented.groupBy(*ATTEMPT).agg(
        F.count_if(impl).alias("implementation_events"),
        F.count_if(impl & (F.col("tool_name") == "Write")).alias("impl_writes"),
        F.count_if(impl & ~F.coalesce(F.col("tool_name") == "Write", F.lit(False))).alias("impl_edits"),
        F.count_distinct(F.when(impl & ~F.coalesce("test_only", F.lit(False)), F.col("turn"))).alias("turns"),
        F.bool_or(check).alias("verified"),
        F.count_if(check & kind.isNotNull()).alias("verification_runs"),
        F.when(had_build, F.when(build, "pass").when(~build, "fail").otherwise("unknown")).alias("build_status"),
        F.when(test["ok"] & test["tests_failed"].isNull(), F.lit(0)).otherwise(test["tests_failed"]).alias("tests_failed"),
        F.min_by(F.struct("failure_sig"), F.when(check & ~ok, F.col("seq")))["failure_sig"].alias("failure_sig"),
        F.min_by("ts_offset", F.when(impl & F.col("ts_offset").isNotNull(), F.col("seq"))).alias("ts_offset"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )
    return grouped.join(change_sets(segmented), ATTEMPT, "left").withColumn(
        "changed_files", F.coalesce("changed_files", F.lit(0))
    )


def attempt_turns(segmented: DataFrame) -> DataFrame:
    counted = _is("implementation") & ~F.coalesce("test_only", F.lit(False)) & F.col("turn").isNotNull()
    return segmented.where(counted).select(*ATTEMPT, "turn").distinct()


def verification_debt(found: DataFrame, turns: DataFrame) -> DataFrame:
    """Trailing attempts without verification, judged by distinct model turns."""
    region = trailing(found, ["session_id"], ["attempt_no"], F.col("verified"))
    distinct = (
        region.select(*ATTEMPT).join(turns, ATTEMPT).groupBy("session_id").agg(F.count_distinct("turn").alias("_turns"))
    )
    known = turns.select(*ATTEMPT).distinct().withColumn("_known", F.lit(True))
    total = (
        region.join(known, ATTEMPT, "left")
        .groupBy("session_id")
        .agg(
            F.count("*").alias("n"),
            F.min("attempt_no").alias("first_attempt"),
            F.max("attempt_no").alias("last_attempt"),
            F.sum("impl_writes").alias("writes"),
            F.sum("impl_edits").alias("edits"),
            F.sum("implementation_events").alias("calls"),
            F.count_if(F.col("_known").isNull()).alias("bare"),
        )
        .join(distinct, "session_id", "left")
        .withColumn("turns", F.coalesce("_turns", F.lit(0)) + F.col("bare"))
        .where("not (writes > 0 and edits = 0)")
    )
    many = F.col("turns") >= 3
    pair = (F.col("turns") == 2) & (F.col("n") >= 2)
    calls = (F.col("bare") > 0) & (F.col("n") == 1) & (F.col("calls") >= 5)
    return total.where(many | pair | calls).select(
        "session_id",
        F.lit("verification-debt").alias("kind"),
        "first_attempt",
        "last_attempt",
        F.when(many, F.concat(F.col("turns").cast("string"), F.lit(" distinct implementation turns were made without collecting any verification evidence")))
        .when(pair, "2 consecutive implementation attempts without any verification run")
        .otherwise(F.concat(F.col("calls").cast("string"), F.lit(" implementation calls were made without collecting any verification evidence")))
        .alias("detail"),
        F.when(many, "HIGH").otherwise("MEDIUM").alias("confidence"),
    )


def attempt_pairs(found: DataFrame) -> DataFrame:
    """Attempts with the attempt before (``prev`` is null for the first)."""
    facts = found.select(*ATTEMPT, "verified", "failure_sig", "change_hash", "tests_failed", "build_status")
    body = F.struct("verified", "failure_sig", "change_hash", "tests_failed", "build_status")
    return ordered_scan(facts, ["session_id"], ["attempt_no"], sequence_chunk("attempt_no"), prev=last_seen(body))


def dead_ends(pairs: DataFrame) -> DataFrame:
    """Runs of verified attempts with one failure signature and a new change each time."""
    usable = F.col("verified") & F.col("failure_sig").isNotNull()
    follows = usable & F.coalesce(F.col("prev.verified") & (F.col("prev.failure_sig") == F.col("failure_sig")), F.lit(False))
    # Null hashes count as equal, so an attempt without fingerprints never reads as a new change.
    novel = ~F.col("change_hash").eqNullSafe(F.col("prev.change_hash"))
    marked = pairs.select(*ATTEMPT, "failure_sig", usable.alias("usable"), follows.alias("follows"), novel.alias("novel"))
    runs = ordered_scan(
        marked, ["session_id"], ["attempt_no"], sequence_chunk("attempt_no"), run=running_sum((~F.col("follows")).cast("int"))
    ).where("usable")
    return (
        runs.groupBy("session_id", "run", "failure_sig")
        .agg(
            F.count("*").alias("n"),
            F.min("attempt_no").alias("first_attempt"),
            F.max("attempt_no").alias("last_attempt"),
            F.coalesce(F.bool_and(F.when(F.col("follows"), F.col("novel"))), F.lit(True)).alias("novel"),
        )
        .where("n >= 2 and novel")
        .select(
            "session_id",
            F.lit("dead-end").alias("kind"),
            "first_attempt",
            "last_attempt",
            F.concat(F.col("n").cast("string"), F.lit(" different patches, same failure signature "), F.col("failure_sig")).alias("detail"),
            F.when(F.col("n") >= 3, "HIGH").otherwise("MEDIUM").alias("confidence"),
        )
    )


def productive(pairs: DataFrame) -> DataFrame:
    """Attempts after which fewer tests fail, or the build passes again."""
    drop = F.col("prev.tests_failed") - F.col("tests_failed")
    fewer = F.when(
        drop > 0,
        F.struct(
            F.concat(F.lit("failed tests "), F.col("prev.tests_failed").cast("string"), F.lit(" → "), F.col("tests_failed").cast("string")).alias("detail"),
            F.when(drop >= 3, "HIGH").otherwise("MEDIUM").alias("confidence"),
        ),
    )
    built = F.when(
        (F.col("prev.build_status") == "fail") & (F.col("build_status") == "pass"),
        F.struct(F.lit("build went fail → pass").alias("detail"), F.lit("HIGH").alias("confidence")),
    )
    return pairs.select(
        "session_id",
        F.lit("productive").alias("kind"),
        (F.col("attempt_no") - 1).alias("first_attempt"),
        F.col("attempt_no").alias("last_attempt"),
        F.inline(F.filter(F.array(fewer, built), lambda x: x.isNotNull())),
    )


def findings(found: DataFrame, turns: DataFrame) -> DataFrame:
    pairs = attempt_pairs(found)
    return verification_debt(found, turns).unionByName(dead_ends(pairs)).unionByName(productive(pairs))


def _rank(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", 3).when(confidence == "MEDIUM", 2).otherwise(1)


def replay_verdict(found: DataFrame, all_findings: DataFrame) -> DataFrame:
    """One row per session with attempts: verdict of the gravest finding and overall confidence."""
    kind = F.col("kind")
    severity = F.when(kind == "verification-debt", 3).when(kind == "dead-end", 2).otherwise(1)
    rank = _rank(F.col("confidence"))
    first = F.struct(severity, rank, -F.col("first_attempt"))
    top = all_findings.groupBy("session_id").agg(
        F.max_by(F.struct("kind", "detail"), first).alias("_top"), F.max(rank).alias("_rank"), F.count("*").alias("findings")
    )
    totals = found.groupBy("session_id").agg(
        F.count("*").alias("attempts"),
        F.sum("verification_runs").alias("verification_runs"),
        F.sum("implementation_events").alias("implementation_calls"),
    )
    return totals.join(top, "session_id", "left").select(
        "session_id",
        "attempts",
        "verification_runs",
        "implementation_calls",
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.when(F.col("_top.kind") == "verification-debt", F.concat(F.lit("⏸ Verification debt: "), F.col("_top.detail")))
        .when(F.col("_top.kind") == "dead-end", "⚠ Different code. Same error.")
        .when(F.col("_top.kind") == "productive", "✓ Productive progress")
        .otherwise("INCONCLUSIVE — no strong pattern in this session")
        .alias("verdict"),
        F.when(F.col("_rank") == 3, "HIGH").when(F.col("_rank") == 2, "MEDIUM").otherwise("INCONCLUSIVE").alias("confidence"),
    )


def top_unverified(all_findings: DataFrame, k: int = 5) -> DataFrame:
    turns = F.coalesce(
        F.nullif(F.regexp_extract("detail", r"(\d+) distinct implementation turns", 1), F.lit("")).cast("bigint"), F.lit(0)
    )
    return (
        all_findings.where("kind = 'verification-debt'")
        .withColumn("turns", turns)
        .orderBy(F.col("turns").desc(), "session_id")
        .limit(k)
    )


def corpus_totals(events: DataFrame, found: DataFrame, all_findings: DataFrame, mobile: DataFrame | None = None) -> DataFrame:
    """One row of totals over all sessions; a turn counts once per session."""
    impl = _is("implementation")
    turn = F.when(impl & ~F.coalesce("test_only", F.lit(False)), F.col("turn"))
    usable = found.select("session_id").distinct()
    per_session = events.groupBy("session_id").agg(F.count_if(impl).alias("_impl"), F.first("source").alias("source"))
    turns = events.where(turn.isNotNull()).join(usable, "session_id", "left_semi").select("session_id", "turn").distinct()
    a = per_session.agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("_impl") > 0).alias("sessions_with_code_changes"),
    )
    b = found.agg(
        F.count("*").alias("attempts"),
        F.coalesce(F.sum("implementation_events"), F.lit(0)).alias("implementation_changes"),
        F.coalesce(F.sum("verification_runs"), F.lit(0)).alias("verification_runs"),
    )
    c = usable.agg(F.count("*").alias("usable_sessions"))
    t = turns.agg(F.count("*").alias("_turns"))
    f = all_findings.agg(
        F.count_if(F.col("kind") == "verification-debt").alias("unverified_stretches"),
        F.count_if(F.col("kind") == "productive").alias("productive_loops"),
    )
    m = (
        mobile.where("mobile").join(usable, "session_id", "left_semi").agg(F.count("*").alias("mobile_sessions"))
        if mobile is not None
        else c.select(F.lit(0).cast("bigint").alias("mobile_sessions"))
    )
    # Six frames of exactly one row each.
    row = a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(t)).join(F.broadcast(f)).join(F.broadcast(m))
    return row.withColumn(
        "implementation_turns", F.when(F.col("_turns") > 0, F.col("_turns")).otherwise(F.col("attempts"))
    ).drop("_turns")


def scan_accounting(files: DataFrame) -> DataFrame:
    """Files seen per source; unreadable ones (``readable`` false) are counted, never dropped."""
    return files.groupBy("source").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("readable")).alias("readable"),
        F.count_if(~F.col("readable")).alias("unreadable"),
    )


def finding_attempts(all_findings: DataFrame, found: DataFrame) -> DataFrame:
    """The attempts inside each finding's range, by equi-join on the attempt numbers of the range."""
    rows = all_findings.select(
        "session_id", "kind", "first_attempt", "last_attempt", "detail", "confidence",
        F.explode(F.sequence("first_attempt", "last_attempt")).alias("attempt_no"),
    )
    ok = (
        F.when(F.col("build_status") == "pass", True)
        .when(F.col("build_status") == "fail", False)
        .when(F.col("verification_runs") > 0, True)
    )
    return rows.join(
        found.select(*ATTEMPT, "implementation_events", "verification_runs", "build_status", "tests_failed", "change_hash", "failure_sig", "ts_offset"),
        ATTEMPT,
    ).withColumn("audit_ok", ok)


def candidates(all_findings: DataFrame, found: DataFrame, kind: str, tokens: DataFrame | None = None, epochs: DataFrame | None = None) -> DataFrame:
    """Audit row per finding of a kind; its attempt-by-attempt trail is ``finding_attempts``."""
    key = ["session_id", "kind", "first_attempt", "last_attempt", "detail", "confidence"]
    rows = (
        finding_attempts(all_findings.where(F.col("kind") == kind), found)
        .groupBy(*key)
        .agg(
            F.sum("implementation_events").alias("implementation_calls"),
            F.sum("verification_runs").alias("verification_runs"),
            (F.count_distinct("change_hash") + F.max(F.col("change_hash").isNull().cast("int"))).alias("distinct_fingerprints"),
            (F.count_distinct("failure_sig") <= 1).alias("failure_signature_stable"),
            F.min("ts_offset").alias("_from"),
            F.max("ts_offset").alias("_to"),
        )
    )
    if tokens is not None and epochs is not None:
        timed = rows.join(epochs.select("session_id", "epoch_ms"), "session_id", "left")
        windows = timed.where("_from is not null and epoch_ms is not null").select(
            *key,
            F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("window_id"),
            (F.col("epoch_ms") + F.col("_from")).alias("from_ms"),
            (F.col("epoch_ms") + F.col("_to") + 60_000).alias("to_ms"),
        )
        used = tokens_in_window(tokens, windows).select("window_id", "tokens")
        rows = rows.withColumn("window_id", F.concat_ws("|", *[F.col(c).cast("string") for c in key])).join(used, "window_id", "left").drop("window_id")
    return rows.drop("_from", "_to")


def tokens_in_window(tokens: DataFrame, windows: DataFrame) -> DataFrame:
    """Growth of a cumulative counter inside each window, against the last record before it.

    An as-of join as one ordered scan: window borders and records are walked together. The start
    border sorts before a record of the same time, the end border after it.
    """
    none = F.lit(None).cast("bigint")
    records = tokens.select(
        "session_id", F.col("ts_ms"), F.lit(0).alias("side"), F.col("record_no").cast("bigint").alias("pos"),
        F.lit(None).cast("string").alias("window_id"), F.col("total_tokens").cast("bigint").alias("total"),
    )
    numbered = windows.select("session_id", F.col("window_id").cast("string").alias("window_id"), "from_ms", "to_ms")
    borders = numbered.select(
        "session_id",
        F.inline(F.array(
            F.struct(F.col("from_ms").alias("ts_ms"), F.lit(-1).alias("side")),
            F.struct(F.col("to_ms").alias("ts_ms"), F.lit(1).alias("side")),
        )),
        F.xxhash64("window_id").alias("pos"), "window_id", none.alias("total"),
    )
    walked = ordered_scan(
        records.unionByName(borders), ["session_id"], ["ts_ms", "side", "pos"], F.floor(F.col("ts_ms") / 86_400_000),
        seen=last_seen(F.struct("ts_ms", "total"), F.col("total").isNotNull()),
    ).where("window_id is not null")
    at = walked.groupBy("window_id").agg(
        F.max_by(F.struct("seen"), F.when(F.col("side") == -1, F.lit(1)))["seen"].alias("before"),
        F.max_by(F.struct("seen"), F.when(F.col("side") == 1, F.lit(1)))["seen"].alias("end"),
    )
    delta = F.col("end.total") - F.coalesce("before.total", F.lit(0))
    return numbered.join(at, "window_id").select(
        "window_id", "session_id", "from_ms", "to_ms",
        F.when((F.col("end.ts_ms") >= F.col("from_ms")) & (delta >= 0), delta).alias("tokens"),
    )


def outcome_of() -> Column:
    """Pass, fail or unknown of a verified attempt."""
    return (
        F.when(F.col("build_status") == "pass", True)
        .when(F.col("build_status") == "fail", False)
        .when(F.col("tests_failed").isNotNull(), F.col("tests_failed") == 0)
    )


def debugging_loop(found: DataFrame) -> DataFrame:
    """Outcomes of the last run that ends in a pass after a failure, one row per attempt."""
    runs = ordered_scan(
        found.select(*ATTEMPT, "verified", outcome_of().alias("ok")),
        ["session_id"], ["attempt_no"], sequence_chunk("attempt_no"), run=running_sum((~F.col("verified")).cast("int")),
    ).where("verified and ok is not null")
    loops = (
        runs.groupBy("session_id", "run")
        .agg(F.min(F.when(~F.col("ok"), F.col("attempt_no"))).alias("_fail"), F.max(F.when(F.col("ok"), F.col("attempt_no"))).alias("_end"))
        .where("_end > _fail")
        .groupBy("session_id")
        .agg(F.max_by(F.struct("run", "_end"), "run").alias("_loop"))
        .select("session_id", "_loop.run", "_loop._end")
    )
    return runs.join(loops, ["session_id", "run"]).where("attempt_no <= _end").select("session_id", "attempt_no", "ok")


def unverified_streak(found: DataFrame) -> DataFrame:
    """Streak of attempts without verification with the most changes; the earlier one on a tie."""
    runs = ordered_scan(
        found.select(*ATTEMPT, "verified", "implementation_events"),
        ["session_id"], ["attempt_no"], sequence_chunk("attempt_no"), run=running_sum(F.col("verified").cast("int")),
    ).where("not verified")
    return (
        runs.groupBy("session_id", "run")
        .agg(F.sum("implementation_events").alias("changes"), F.count("*").alias("attempts"))
        .groupBy("session_id")
        .agg(F.max_by(F.struct("changes", "attempts"), F.struct("changes", -F.col("run"))).alias("s"))
        .select("session_id", "s.changes", "s.attempts")
    )


def final_state(found: DataFrame) -> DataFrame:
    last = F.max_by(F.struct(outcome_of().alias("ok")), F.when(F.col("verified"), F.col("attempt_no")))["ok"]
    return found.groupBy("session_id").agg(
        F.when(last, "recognized verification found")
        .when(~last, "last recognized verification failed")
        .otherwise("no recognized verification")
        .alias("final_state")
    )


def most_touched(events: DataFrame) -> DataFrame:
    """Path with the most changes and reads; the first seen on a tie."""
    touched = _is("implementation") | (_is("observation") & (F.col("tool_name") == "Read"))
    return (
        events.where(touched & (F.col("path") != ""))
        .groupBy("session_id", "path")
        .agg(F.count("*").alias("touches"), F.min("seq").alias("_first"))
        .groupBy("session_id")
        .agg(F.max_by(F.struct("path", "touches"), F.struct("touches", -F.col("_first"))).alias("b"))
        .select("session_id", "b.path", "b.touches")
    )


def flight_facts(events: DataFrame, found: DataFrame, read_sources: tuple[str, ...] = ("claude",)) -> DataFrame:
    """Span, reads, edits and verification runs per session; reads only where the source names them."""
    spans = events.groupBy("session_id").agg(
        F.first("source").alias("source"),
        (F.max("ts_offset") - F.min("ts_offset")).alias("span_ms"),
        F.count_if(_is("observation") & (F.col("tool_name") == "Read")).alias("_reads"),
    )
    totals = found.groupBy("session_id").agg(
        F.sum("implementation_events").alias("edits"), F.sum("verification_runs").alias("verification_runs")
    )
    return spans.join(totals, "session_id", "left").select(
        "session_id",
        "source",
        "span_ms",
        F.when(F.col("source").isin(*read_sources), F.col("_reads")).alias("reads"),
        F.coalesce("edits", F.lit(0)).alias("edits"),
        F.coalesce("verification_runs", F.lit(0)).alias("verification_runs"),
    )


def recent_coding(events: DataFrame, prefix: str = "") -> DataFrame:
    """Sessions with implementation work, newest first; optional id prefix."""
    return (
        events.where(F.startswith("session_id", F.lit(prefix)))
        .groupBy("session_id")
        .agg(F.count_if(_is("implementation")).alias("implementation_calls"), F.max("last_ms").alias("last_ms"))
        .where("implementation_calls > 0")
        .orderBy(F.col("last_ms").desc(), "session_id")
    )


def compare_sessions(facts: DataFrame, a: str, b: str) -> DataFrame:
    """Metric rows of two sessions side by side."""
    metrics = ("span_ms", "edits", "verification_runs", "reads", "streak_changes", "most_touched", "final_state")
    present = [m for m in metrics if m in facts.columns]
    long = facts.where(F.col("session_id").isin(a, b)).select(
        "session_id",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in present])),
    )
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("session_id") == a, F.col("value"))).alias("a"),
        F.max(F.when(F.col("session_id") == b, F.col("value"))).alias("b"),
    )


def attempt_timeline(segmented: DataFrame, found: DataFrame) -> DataFrame:
    """One row per verification of each attempt, and one for an attempt without any."""
    n, ok = F.col("tests_failed"), F.col("ok")
    failing = F.coalesce(F.concat(F.lit(" ("), n.cast("string"), F.lit(" failing)")), F.lit(""))
    kind = F.coalesce("verification_kind", F.lit("run"))
    text = (
        F.when(~ok, F.concat(kind, F.lit(": FAILED"), failing))
        .when(ok, F.concat(kind, F.lit(": passed"), failing))
        .otherwise(F.concat(kind, F.lit(": unknown")))
    )
    checks = segmented.where(_is("verification")).select(*ATTEMPT, "seq", text.alias("verification"))
    edits = F.concat(
        F.col("implementation_events").cast("string"), F.when(F.col("implementation_events") == 1, " edit").otherwise(" edits")
    )
    return found.select(*ATTEMPT, "ts_offset", edits.alias("edits")).join(checks, ATTEMPT, "left").select(
        *ATTEMPT,
        (F.col("ts_offset") / 1000).alias("offset_s"),
        "edits",
        "seq",
        F.coalesce("verification", F.lit("NOT VERIFIED")).alias("verification"),
    )


def escalate(policies: DataFrame, all_findings: DataFrame) -> DataFrame:
    """Any verification-debt finding turns the policy to VERIFY_FIRST."""
    debt = all_findings.where("kind = 'verification-debt'").select("session_id").distinct().withColumn("_debt", F.lit(True))
    return policies.join(debt, "session_id", "left").withColumn(
        "policy", F.when(F.col("_debt"), "VERIFY_FIRST").otherwise(F.col("policy"))
    ).drop("_debt")


def change_gaps(events: DataFrame) -> DataFrame:
    """Time between consecutive implementation events of a session."""
    work = events.where(_is("implementation") & F.col("ts_offset").isNotNull()).select("session_id", "seq", "ts_offset")
    seen = ordered_scan(work, ["session_id"], ["seq"], sequence_chunk("seq"), prev=last_seen(F.col("ts_offset")))
    return seen.where("prev is not null").select("session_id", "seq", (F.col("ts_offset") - F.col("prev")).alias("gap_ms"))


def gap_buckets(gaps: DataFrame) -> DataFrame:
    g = F.col("gap_ms")
    label = (
        F.when(g <= 10_000, "<=10s").when(g <= 60_000, "10-60s").when(g <= 300_000, "1-5min")
        .when(g <= 1_800_000, "5-30min").when(g <= 7_200_000, "30min-2h").otherwise(">2h")
    )
    return gaps.groupBy(label.alias("bucket")).agg(F.count("*").alias("gaps"))


def gap_quantiles(gaps: DataFrame, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Exact order statistics, at index floor(p·n), over value counts; no task sees all values."""
    counts = gaps.groupBy("gap_ms").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    walked = ordered_scan(counts, ["all"], ["gap_ms"], F.floor(F.col("gap_ms") / 60_000), upto=running_sum(F.col("n")))
    total = gaps.agg(F.count("*").alias("total"))
    wanted = total.select("total", F.explode(F.array(*[F.lit(p) for p in shares])).alias("share")).withColumn(
        "idx", F.least(F.col("total") - 1, F.floor(F.col("share") * F.col("total")))
    )
    # ``wanted`` holds one row per share.
    return walked.join(F.broadcast(wanted), (F.col("idx") >= F.col("upto") - F.col("n")) & (F.col("idx") < F.col("upto"))).select(
        "share", "gap_ms", F.col("total").alias("gaps")
    )


def batch_sizes(events: DataFrame) -> DataFrame:
    """How many tool calls a model turn with implementation work made."""
    turns = events.where("turn is not null").groupBy("session_id", "turn").agg(
        F.count("*").alias("calls"), F.count_if(_is("implementation")).alias("impl")
    ).where("impl > 0")
    return turns.groupBy("calls").agg(F.count("*").alias("batches"), F.count_if(F.col("impl") > 1).alias("multi_impl"))


def verify_first(events: DataFrame, threshold: int = 3) -> DataFrame:
    """First event of each episode at which the distinct content fingerprints reach the threshold.

    An episode is the stretch of implementations between verifications. A fingerprint counts at its
    first use in the episode, so one aggregate and one running count answer it.
    """
    check = _is("verification") & F.col("verification_kind").isNotNull() & (F.col("verification_kind") != "other")
    impl = _is("implementation") & (F.col("fingerprint_basis") == "content") & F.col("change_hash").isNotNull()
    work = events.where(check | impl).select("session_id", "seq", "change_hash", check.alias("check"))
    parts = ordered_scan(work, ["session_id"], ["seq"], sequence_chunk("seq"), episode=running_sum(F.col("check").cast("int"))).where("not check")
    firsts = parts.groupBy("session_id", "episode", "change_hash").agg(F.min("seq").alias("seq"))
    ranked = ordered_scan(firsts, ["session_id", "episode"], ["seq"], sequence_chunk("seq"), distinct_edits=running_sum(F.lit(1)))
    start = firsts.groupBy("session_id", "episode").agg(F.min_by("change_hash", "seq").alias("episode_start"))
    return ranked.where(F.col("distinct_edits") == threshold).join(start, ["session_id", "episode"]).select(
        "session_id", "seq", "distinct_edits", "episode_start"
    )


def opportunities(events: DataFrame, threshold: int = 3) -> DataFrame:
    """Batches of hook events (``batch_id``): the third one in a row with changes and no verification warns."""
    check = _is("verification") & F.col("verification_kind").isNotNull() & (F.col("verification_kind") != "other")
    impl = _is("implementation") & ~F.coalesce("test_only", F.lit(False))
    batches = events.groupBy("session_id", "batch_id").agg(F.bool_or(check).alias("check"), F.bool_or(impl).alias("impl")).where("check or impl")
    reset = ordered_scan(batches, ["session_id"], ["batch_id"], sequence_chunk("batch_id"), run=running_sum(F.col("check").cast("int"))).where("not check")
    counted = ordered_scan(reset, ["session_id", "run"], ["batch_id"], sequence_chunk("batch_id"), opportunities=running_sum(F.lit(1)))
    return counted.where(F.col("opportunities") == threshold).select("session_id", "batch_id", "opportunities")
