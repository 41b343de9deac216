"""Evaluation of attempt series: pair signals, streaks, goal progress and policy.

One ordered scan pairs each attempt with the one before; everything else is one aggregate per series.
``idx`` is the dense position of an attempt in its series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import last_seen, ordered_scan, sequence_chunk

CLEAN_RUNTIME = "(no crash observed)"
FIELDS = ("attempt_id", "build_status", "tests_failed", "crash_sig", "screen_sig", "verified", "changed_files", "change_hash")


def is_code_changing() -> Column:
    return (F.coalesce("changed_files", F.lit(0)) > 0) | F.col("change_hash").isNotNull()


def _appeared_gone(name: str) -> Column:
    """Changed when both are known and differ, or when a known value was looked for and is gone."""
    before, now = F.col(f"prev.{name}"), F.col(name)
    return F.when(before.isNotNull() & now.isNotNull(), before != now).when(
        before.isNotNull() & F.col("verified") & now.isNull(), F.lit(True)
    )


def pair_signals(evidence: DataFrame) -> DataFrame:
    """Every attempt with its predecessor (``prev``, null for the first) and the pair's signals."""
    paired = ordered_scan(
        evidence.select("series_id", "idx", *FIELDS), ["series_id"], ["idx"], sequence_chunk("idx"), prev=last_seen(F.struct(*FIELDS))
    )
    return paired.select(
        "*",
        (F.col("prev.build_status") != F.col("build_status")).alias("build_changed"),
        (F.col("tests_failed") - F.col("prev.tests_failed")).alias("failed_delta"),
        _appeared_gone("crash_sig").alias("crash_changed"),
        _appeared_gone("screen_sig").alias("screen_changed"),
        (F.col("prev.change_hash") != F.col("change_hash")).alias("code_novelty"),
    )


def _streak(value: Column, before: Column) -> Column:
    """Length of the trailing run of one known value."""
    starts = F.max(F.when(F.col("prev").isNull() | ~value.eqNullSafe(before), F.col("idx")))
    known = F.max_by(value.isNotNull(), "idx")
    return F.when(known, F.max("idx") - starts + 1).otherwise(0)


def series_signals(pairs: DataFrame) -> DataFrame:
    """One row per series: counts, trailing streaks, debt, dead-end parts and the latest pair."""

    def crash(prefix=""):
        verified = F.col(f"{prefix}verified")
        return F.coalesce(F.col(f"{prefix}crash_sig"), F.when(verified, CLEAN_RUNTIME))

    has_prev = F.col("prev").isNotNull()
    moved = (
        F.coalesce(F.col("crash_changed"), F.lit(False))
        | F.coalesce(F.col("screen_changed"), F.lit(False))
        | F.coalesce(F.col("failed_delta") != 0, F.lit(False))
    )
    holds = is_code_changing() & ~F.col("verified")
    latest = F.struct(
        "prev", *FIELDS, "build_changed", "failed_delta", "crash_changed", "screen_changed", "code_novelty"
    )
    return pairs.groupBy("series_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(is_code_changing()).alias("changed_implementations"),
        _streak(crash(), crash("prev.")).alias("crash_streak"),
        _streak(F.col("screen_sig"), F.col("prev.screen_sig")).alias("screen_streak"),
        _streak(F.col("tests_failed"), F.col("prev.tests_failed")).alias("tests_streak"),
        (F.max("idx") - F.coalesce(F.max(F.when(~holds, F.col("idx"))), F.min("idx") - 1)).alias("debt_streak"),
        F.coalesce(F.bool_and(F.when(has_prev, F.coalesce("code_novelty", F.lit(False)))), F.lit(True)).alias("all_novel"),
        F.coalesce(F.bool_or(has_prev & moved), F.lit(False)).alias("any_moved"),
        F.max_by(latest, "idx").alias("last"),
    )


def debt_level(n: Column) -> Column:
    return F.when(n >= 3, "HIGH").when(n == 2, "MEDIUM").otherwise("LOW")


def dead_end() -> Column:
    return (
        (F.col("attempts") >= 3) & F.col("all_novel") & ~F.col("any_moved") & (F.col("crash_streak") >= 3) & (F.col("screen_streak") >= 3)
    )


def latest_pair(signals: DataFrame) -> DataFrame:
    """How much the last pair moved, and what it taught."""
    fewer = F.coalesce(F.col("last.failed_delta") < 0, F.lit(False))
    flags = {
        "tests_improved": fewer,
        **{f"{x}_moved": F.coalesce(F.col(f"last.{x}_changed"), F.lit(False)) for x in ("crash", "screen", "build")},
    }
    n = sum((f.cast("int") for f in flags.values()), F.lit(0))
    detail = F.filter(
        F.array(
            F.when(flags["tests_improved"], F.concat(F.lit("failing tests "), F.col("last.failed_delta").cast("string"))),
            F.when(flags["crash_moved"], "crash signature changed"),
            F.when(flags["screen_moved"], "screen changed"),
            F.when(flags["build_moved"], "build status changed"),
        ),
        lambda x: x.isNotNull(),
    )
    return signals.withColumn("_n", n).select(
        "series_id",
        F.when(F.col("_n") >= 2, "MULTIPLE").when(F.col("_n") == 1, "SINGLE").otherwise("NONE").alias("runtime_change"),
        F.when(F.col("_n") >= 2, "HIGH").when(F.col("_n") == 1, "MEDIUM").otherwise("LOW").alias("evidence_gain"),
        F.array_join(detail, "; ").alias("details"),
    )


def goal_progress(signals: DataFrame, latest: DataFrame, contracts: DataFrame | None) -> DataFrame:
    """Goal movement of the last pair against the declared contract; UNKNOWN without one."""
    base = signals.join(latest, "series_id")
    if contracts is None:
        base = base.withColumns({
            "has_contract": F.lit(False), "crash_must_disappear": F.lit(False), "tests_must_decrease": F.lit(False),
            "target_screen": F.lit(None).cast("string"), "baseline_screen": F.lit(None).cast("string"),
        })
    else:
        base = base.join(contracts.withColumn("has_contract", F.lit(True)), "series_id", "left")
    no = F.lit(False)
    wants_clean = F.coalesce("crash_must_disappear", no)
    crash0, crash1 = F.col("last.prev.crash_sig"), F.col("last.crash_sig")
    screen0, screen1 = F.col("last.prev.screen_sig"), F.col("last.screen_sig")
    target, baseline, delta = F.col("target_screen"), F.col("baseline_screen"), F.col("last.failed_delta")
    flags = base.withColumns({
        "_pair": F.col("last.prev").isNotNull() & F.coalesce("has_contract", no),
        "_removed": wants_clean & crash0.isNotNull() & crash1.isNull() & F.col("last.verified"),
        "_reached": target.isNotNull() & ~screen0.eqNullSafe(target) & screen1.eqNullSafe(target),
        "_fewer": F.coalesce("tests_must_decrease", no) & F.coalesce(delta < 0, no),
        "_lost": baseline.isNotNull() & screen0.eqNullSafe(baseline) & ~screen1.eqNullSafe(baseline),
        "_new_crash": crash0.isNull() & crash1.isNotNull() & F.col("last.verified"),
        "_persists": wants_clean & crash0.isNotNull() & crash1.isNotNull(),
        "_same_crash": wants_clean & F.coalesce(crash0 == crash1, no),
        "_same_screen": F.coalesce(screen0 == screen1, no),
        "_same_tests": F.coalesce(delta == 0, no),
    })
    still = F.col("runtime_change") == "NONE"
    level = (
        F.when(~F.col("_pair"), "UNKNOWN")
        .when(F.col("_removed") | F.col("_reached"), "HIGH")
        .when(F.col("_lost") | F.col("_new_crash"), "LOW")
        .when(F.col("_fewer"), "MEDIUM")
        .when(~still & F.col("_persists"), "UNKNOWN")
        .when(still, "LOW")
        .otherwise("UNKNOWN")
    )

    def listed(*items):
        kept = F.filter(F.array(*[F.when(F.col("_pair") & c, text) for c, text in items]), lambda x: x.isNotNull())
        return F.array_join(kept, "; ")

    return flags.select(
        "series_id",
        level.alias("goal_level"),
        listed(
            (F.col("_removed"), F.lit("crash disappears")),
            (F.col("_reached"), F.concat(F.lit("target screen reached ("), target, F.lit(")"))),
            (F.col("_fewer"), F.concat(F.lit("failing tests decreased ("), delta.cast("string"), F.lit(")"))),
        ).alias("success_signals"),
        listed(
            (F.col("_same_crash"), F.lit("same crash")),
            (F.col("_same_screen"), F.lit("same screen")),
            (F.col("_same_tests"), F.lit("same failed tests")),
        ).alias("no_progress_signals"),
    )


def policy(signals: DataFrame, goals: DataFrame) -> DataFrame:
    """VERIFY_FIRST before RETHINK before HUMAN_REVIEW before OBSERVE."""
    debt = debt_level(F.col("debt_streak"))
    failing = F.coalesce(F.col("last.build_status") == "fail", F.lit(False))
    choice = F.when(debt == "HIGH", "VERIFY_FIRST").when(dead_end(), "RETHINK").when(failing, "HUMAN_REVIEW").otherwise("OBSERVE")
    verdict = (
        F.when(debt == "HIGH", F.concat(F.lit("⏸ "), F.col("debt_streak").cast("string"), F.lit(" implementation attempts were made without collecting new runtime evidence.")))
        .when(dead_end(), "⚠ Different code. Same app.")
        .when(failing, "‼ Build is failing — escalate for human review.")
        .when(F.col("goal_level") == "HIGH", "✓ Productive progress — goal evidence improved.")
        .otherwise("• No strong signal yet — observe.")
    )
    return signals.join(goals.select("series_id", "goal_level"), "series_id").select(
        "series_id", debt.alias("debt_level"), dead_end().alias("dead_end"), choice.alias("policy"), verdict.alias("verdict")
    )


def pair_payload(pairs: DataFrame) -> DataFrame:
    """Normalized view of each pair for an outside judge: counts, flags and capped signatures only."""
    from ..functions.text import sanitize_signature

    def view(prefix, name):
        c = {f: F.col(f"{prefix}{f}") for f in FIELDS}
        return F.struct(
            sanitize_signature(c["attempt_id"], 40).alias("attempt_id"),
            c["build_status"].alias("build"),
            c["tests_failed"].alias("tests_failed"),
            sanitize_signature(c["crash_sig"]).alias("crash_sig"),
            sanitize_signature(c["screen_sig"]).alias("screen_sig"),
            ((F.coalesce(c["changed_files"], F.lit(0)) > 0) | c["change_hash"].isNotNull()).alias("code_changed"),
            c["changed_files"].alias("changed_files"),
        ).alias(name)

    return pairs.where("prev is not null").select(
        "series_id", "idx", view("prev.", "previous"), view("", "current"),
        "build_changed", "failed_delta", "crash_changed", "screen_changed", "code_novelty",
    )


def payload_issues(payload: Column) -> Column:
    """Privacy problems of a serialized payload: absolute paths, secret-like words, long fields."""
    text = F.to_json(payload)
    # What must not occur.
    rules = (
        (r"[A-Za-z]:\\", "absolute path (drive)"),
        (r"""(?:^|[\s"'=])/(?:home|Users|root|tmp|var|mnt)/""", "absolute path (posix)"),
        (r"(?:^|/)Users/", "absolute path (users)"),
        (r"(?i)api[_-]?key", "secret: api key"),
        (r"(?i)authorization", "secret: authorization"),
        (r"(?i)bearer\s", "secret: bearer"),
        (r"(?i)password", "secret: password"),
        (r"(?i)secret", "secret: secret"),
        (r"(?i)token", "secret: token"),
    )
    fields = [payload[v][f] for v in ("previous", "current") for f in ("attempt_id", "crash_sig", "screen_sig")]
    long = F.exists(F.array(*fields), lambda x: F.length(x) > 120)
    return F.filter(
        F.array(*[F.when(text.rlike(p), name) for p, name in rules], F.when(F.coalesce(long, F.lit(False)), "over-length field")),
        lambda x: x.isNotNull(),
    )


def evaluate_series(evidence: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Signals, latest pair, goal progress and policy in one row per series."""
    signals = series_signals(pair_signals(evidence))
    latest = latest_pair(signals)
    goals = goal_progress(signals, latest, contracts)
    return (
        signals.drop("last", "all_novel", "any_moved")
        .join(latest, "series_id")
        .join(goals, "series_id")
        .join(policy(signals, goals), "series_id")
    )
