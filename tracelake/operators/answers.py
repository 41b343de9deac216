"""Answers: scope, identity resolution, pages, retention.

``answers``: receipt_id, run_id, answer_id, agent_id, agent_session_id, turn_id, answer_hash,
hash_version, ts_ms, scope_declared (false when the boundary is unknown). ``scope``: receipt_id,
event_id, scope (own or shared). An empty declared scope has no scope rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import is_event_id, is_run_id
from .ordered import last_seen, ordered_scan, running_sum, sequence_chunk

HASH_VERSION = "sha256-sanitized-nfc-lf-v1"
CONTEXT_FIELDS = ("agent_id", "agent_session_id", "turn_id", "receipt_id", "run_id", "answer_id", "answer_hash", "hash_version")


def answer_scope_status(answers: DataFrame, scope: DataFrame, events: DataFrame) -> DataFrame:
    """EXPLICIT only when ids are declared, all are present and none is owned by another receipt.

    Conflicts are counted per event from the number of owners, so receipts that share an event are
    never paired with each other.
    """
    placed = scope.join(answers.select("receipt_id", "run_id"), "receipt_id")
    known = events.select("run_id", "event_id", F.lit(True).alias("_known"))
    owners = placed.where("scope = 'own'").groupBy("run_id", "event_id").agg(F.count("*").alias("_owners"))
    other = F.when(F.col("scope") == "own", F.coalesce("_owners", F.lit(0)) - 1).otherwise(0)
    counted = (
        placed.join(known, ["run_id", "event_id"], "left")
        .join(owners, ["run_id", "event_id"], "left")
        .groupBy("receipt_id")
        .agg(
            F.count_if(F.col("_known").isNull()).alias("missing"),
            F.count_if("_known").alias("event_count"),
            F.sum(other).alias("conflicts"),
            F.count_if(F.col("scope") == "own").alias("own_declared"),
            F.count_if(F.col("scope") == "shared").alias("shared_declared"),
        )
    )
    out = answers.select("receipt_id", "run_id", "scope_declared").join(counted, "receipt_id", "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("missing", "event_count", "conflicts", "own_declared", "shared_declared")}
    out = out.withColumns(zeros)
    explicit = F.col("scope_declared") & (F.col("missing") == 0) & (F.col("conflicts") == 0)
    return out.withColumn("status", F.when(explicit, "EXPLICIT").otherwise("UNKNOWN"))


def missing_events(answers: DataFrame, scope: DataFrame, events: DataFrame) -> DataFrame:
    """Scope ids that no event of the run has."""
    return scope.join(answers.select("receipt_id", "run_id"), "receipt_id").join(
        events.select("run_id", "event_id"), ["run_id", "event_id"], "left_anti"
    )


def conflicted_receipts(answers: DataFrame, duplicates: DataFrame) -> DataFrame:
    clash = duplicates.where("record_kind = 'answer' and duplicate_kind = 'CONFLICTING'").select(
        "run_id", F.col("record_id").alias("receipt_id")
    )
    return answers.join(clash, ["run_id", "receipt_id"], "left_semi").select("receipt_id", "run_id")


def validate_context(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts whose supplied fields are well formed, and the others."""
    rules = []
    for name in CONTEXT_FIELDS:
        c = F.col(name)
        good = (
            c.rlike(r"^[a-f0-9]{64}\z") if name == "answer_hash"
            else (c == HASH_VERSION) if name == "hash_version"
            else is_run_id(c) if name == "run_id"
            else is_event_id(c)
        )
        rules.append(c.isNull() | good)
    valid = rules[0]
    for r in rules[1:]:
        valid = valid & r
    return contexts.where(valid), contexts.where(~valid)


def resolve_answers(contexts: DataFrame, answers: DataFrame, scope_status: DataFrame, conflicted: DataFrame) -> DataFrame:
    """Match each context (``context_id``) to a stored answer, or say why it cannot be.

    Agent, session and turn come first, then the receipt id; a hash alone never proves identity.
    """
    by_turn = F.col("agent_id").isNotNull() & F.col("agent_session_id").isNotNull() & F.col("turn_id").isNotNull()
    basis = (
        F.when(by_turn, "session-turn").when(F.col("receipt_id").isNotNull(), "receipt")
        .when(F.col("answer_hash").isNotNull(), "hash-only").otherwise("none")
    )
    ctx = contexts.withColumn("basis", basis)
    cand = answers.select(*[F.col(c).alias(f"a_{c}") for c in CONTEXT_FIELDS])
    turn_key = ["a_agent_id", "a_agent_session_id", "a_turn_id"]
    turns = cand.where(F.col("a_agent_session_id").isNotNull() & F.col("a_turn_id").isNotNull()).groupBy(*turn_key).agg(
        F.count("*").alias("_n"), F.min(F.struct(*[c for c in cand.columns])).alias("_cand")
    )
    one = ctx.where("basis = 'session-turn'").join(
        turns, (F.col("agent_id") == F.col("a_agent_id")) & (F.col("agent_session_id") == F.col("a_agent_session_id")) & (F.col("turn_id") == F.col("a_turn_id")), "left"
    ).drop(*turn_key)
    receipts = cand.select(F.col("a_receipt_id").alias("_rid"), F.lit(1).cast("bigint").alias("_n"), F.struct(*cand.columns).alias("_cand"))
    two = ctx.where("basis = 'receipt'").join(receipts, F.col("receipt_id") == F.col("_rid"), "left").drop("_rid")
    rest = ctx.where("basis in ('hash-only', 'none')").withColumns(
        {"_n": F.lit(None).cast("bigint"), "_cand": F.lit(None).cast(two.schema["_cand"].dataType)}
    )
    rows = one.unionByName(two).unionByName(rest)
    rows = rows.withColumn("_receipt", F.col("_cand.a_receipt_id"))
    flags = scope_status.select(F.col("receipt_id").alias("_receipt"), F.col("status").alias("_scope"))
    clash = conflicted.select(F.col("receipt_id").alias("_receipt")).distinct().withColumn("_clash", F.lit(True))
    rows = rows.join(flags, "_receipt", "left").join(clash, "_receipt", "left")

    names = {
        "agent_id": "AGENTID", "agent_session_id": "AGENTSESSIONID", "turn_id": "TURNID", "receipt_id": "RECEIPTID",
        "run_id": "RUNID", "answer_id": "ANSWERID", "answer_hash": "ANSWERHASH", "hash_version": "HASHVERSION",
    }
    wrong = F.when(F.lit(False), "")
    for c in CONTEXT_FIELDS:
        wrong = wrong.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_cand.a_{c}")), f"CONFLICTING_{names[c]}")
    hashless = F.col("answer_hash").isNotNull() & ~F.col("hash_version").eqNullSafe(F.col("_cand.a_hash_version"))
    rows = rows.withColumn("_wrong", wrong)
    def says(status, reason):
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    proven = F.when(F.col("answer_hash").isNotNull(), "IDENTITY_AND_HASH_CORROBORATED").otherwise("EXPLICIT_IDENTITY")
    verdict = (
        F.when(F.col("basis") == "hash-only", says("uncertain", "HASH_CANNOT_ESTABLISH_IDENTITY"))
        .when(F.col("basis") == "none", says("uncertain", "ANSWER_CONTEXT_REQUIRED"))
        .when(F.col("_n").isNull() & (F.col("basis") == "session-turn"), says("missing", "TURN_NOT_FOUND"))
        .when(F.col("_n").isNull(), says("missing", "RECEIPT_NOT_FOUND"))
        .when(F.col("_n") > 1, says("uncertain", "MULTIPLE_FINAL_ANSWERS_FOR_TURN"))
        .when(F.col("_wrong").isNotNull(), says("mismatch", F.col("_wrong")))
        .when(hashless, says("mismatch", "HASH_POLICY_REQUIRED"))
        .when(F.col("_clash"), says("mismatch", "RECEIPT_PAYLOAD_CONFLICT"))
        .when(~F.col("_scope").eqNullSafe(F.lit("EXPLICIT")), says("uncertain", "ANSWER_SCOPE_UNKNOWN"))
        .otherwise(says("matched", proven))
    )
    return rows.withColumn("_v", verdict).select(
        "context_id", "basis", "_v.status", "_v.reason", F.when(F.col("_v.status") == "matched", F.col("_receipt")).alias("matched_receipt")
    )


def recent(rows: DataFrame, ts: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of rows, newest first; ask for one more than the page to know whether another follows."""
    return rows.orderBy(F.col(ts).desc(), key).offset(offset).limit(limit)


def picker_page(answers: DataFrame, runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Recent answers and runs of one page, marked by section; ``has_more`` tells of a next page."""
    a = recent(answers, "ts_ms", "receipt_id", limit + 1, offset).select(
        F.lit("answer").alias("section"), F.col("receipt_id").alias("id"), "run_id", "ts_ms"
    )
    r = recent(runs, "updated_ms", "run_id", limit + 1, offset).select(
        F.lit("run").alias("section"), F.col("run_id").alias("id"), "run_id", F.col("updated_ms").alias("ts_ms")
    )
    return a.unionByName(r)


def event_page(events: DataFrame, run_id: str, cursor: int, limit: int, scope: DataFrame | None = None, max_bytes: int = 1 << 20) -> DataFrame:
    """Events after a cursor in one run or receipt scope, bounded by rows and bytes (at least one row)."""
    rows = events.where((F.col("run_id") == run_id) & (F.col("sequence") > cursor))
    if scope is not None:
        rows = rows.join(scope.select("event_id").distinct(), "event_id", "left_semi")
    page = rows.orderBy("sequence").limit(limit)
    # The page has at most ``limit`` rows, so the running byte sum is over a bounded frame.
    sized = ordered_scan(page, ["run_id"], ["sequence"], sequence_chunk(), bytes=running_sum(F.col("n_bytes")), before=running_sum(F.col("n_bytes"), inclusive=False))
    return sized.where((F.col("before") == 0) | (F.col("bytes") <= max_bytes)).drop("before")


def scoped_extent(scope: DataFrame, answers: DataFrame, events: DataFrame) -> DataFrame:
    """Number of events and highest sequence per receipt."""
    return (
        scope.join(answers.select("receipt_id", "run_id"), "receipt_id")
        .join(events.select("run_id", "event_id", "sequence"), ["run_id", "event_id"])
        .groupBy("receipt_id")
        .agg(F.count("*").alias("events"), F.max("sequence").alias("max_sequence"))
    )


def answer_report(answers: DataFrame, runs: DataFrame, scope_status: DataFrame, conflicted: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """One row per answer: integrity, capability, scope counts and, while fresh, its support."""
    clash = conflicted.select("receipt_id").distinct().withColumn("_clash", F.lit(True))
    out = (
        answers.join(runs.select("run_id", "lifecycle"), "run_id", "left")
        .join(scope_status.drop("run_id", "scope_declared"), "receipt_id", "left")
        .join(clash, "receipt_id", "left")
    )
    if support is not None:
        out = out.join(support.select("receipt_id", "support"), "receipt_id", "left")
    else:
        out = out.withColumn("support", F.lit(None).cast("string"))
    return out.select(
        "receipt_id",
        "run_id",
        "lifecycle",
        F.when(F.col("_clash"), "CONFLICTED").otherwise("STORED").alias("receipt_integrity"),
        F.when(F.col("agent_session_id").isNotNull() & F.col("turn_id").isNotNull(), "YES").otherwise("PARTIAL").alias("association_capability"),
        "status",
        "missing",
        "conflicts",
        "event_count",
        F.when(F.col("scope_declared"), F.col("own_declared")).alias("own_declared"),
        "shared_declared",
        F.coalesce("support", F.lit("UNKNOWN")).alias("support"),
    )


def retention_candidates(runs: DataFrame, keeps: DataFrame, tombstones: DataFrame, before_ms: int) -> DataFrame:
    """Runs older than the cutoff that nobody kept, that are not active and not deleted yet."""
    return (
        runs.where((F.col("updated_ms") < before_ms) & ~F.col("lifecycle").isin("RUNNING", "CREATED"))
        .join(keeps.select("run_id"), "run_id", "left_anti")
        .join(tombstones.select("run_id"), "run_id", "left_anti")
    )


def record_selection(selections: DataFrame, chosen: DataFrame, answers: DataFrame, runs: DataFrame) -> DataFrame:
    """Append the chosen targets that exist: a known run and, if given, a receipt of that run."""
    known = chosen.join(runs.select("run_id"), "run_id", "left_semi")
    with_receipt = known.where("receipt_id is not null").join(answers.select("receipt_id", "run_id"), ["receipt_id", "run_id"], "left_semi")
    return selections.unionByName(known.where("receipt_id is null")).unionByName(with_receipt.select(*known.columns))
