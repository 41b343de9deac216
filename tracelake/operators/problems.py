"""Problem detection, recovery, follow-ups and the problems-only view.

A failure opens a problem, later failures of the same kind are further attempts of it, and the first
proof of recovery (or the end of the session) closes it. For each kind this is a gaps-and-islands
question, so one skew-safe running count over (session, family, kind, command) answers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import problems as P
from ..functions.text import first_line
from ..runtime import stage
from .ordered import ordered_scan, running_sum, sequence_chunk, time_chunk
from .sessions import ORDER, agent, position

GROUP = ["session_id", "family", "kind", "cmd"]
ISLAND_KINDS = ("test-failure", "build-failure", "error", "command-failure")
FOLLOW_UP_TYPES = (
    "FILE_CHANGED", "FILE_CREATED", "FILE_DELETED", "FILE_READ", "COMMAND_STARTED", "TEST_STARTED", "BUILD_STARTED",
)
_NO_COMMAND = "\u0000"


def _facts(events: DataFrame) -> DataFrame:
    """Rows that can open or close a problem, with the columns a problem row needs.

    Each column is derived once from the one before, so the regular expressions run once per row.
    """
    t = F.col("type")
    failure = F.col("failure")
    external = F.col("external")
    kept = (
        events.withColumn("failure", P.is_failure())
        .where(failure | t.isin("TEST_PASSED", "BUILD_PASSED", "SESSION_COMPLETED", "COMMAND_COMPLETED", *P.AGENT_START))
        .withColumn("ok", P.command_ok())
        .where(failure | F.col("ok") | (t != "COMMAND_COMPLETED"))
        .withColumn("own_kind", F.when(failure, P.problem_kind()))
        .withColumn("error_identity", F.when(failure, first_line(F.col("error"))))
        .withColumn("cls", F.when(failure, P.classify_problem(F.col("own_kind"), F.col("error_identity"))))
        .withColumn("category", F.col("cls.category"))
        .withColumn("provider_detail", F.col("cls.detail"))
        .withColumn("external", F.coalesce(F.col("category").isin("PROVIDER", "ENVIRONMENT"), F.lit(False)))
    )
    proof = ~(t == "SESSION_COMPLETED") | F.coalesce(
        (F.col("meta_outcome") == "success") | (F.col("meta_status") == "success"), F.lit(False)
    )
    passed = F.when(
        t.isin("TEST_PASSED", "BUILD_PASSED") | F.col("ok"),
        F.array(*[F.when(P.positive_for(F.lit(k)), F.lit(k)) for k in ISLAND_KINDS + ("timeout", "abort")]),
    )
    return kept.select(
        "session_id",
        "family",
        *ORDER,
        "id",
        "type",
        "command",
        "meta_task",
        agent().alias("agent_id"),
        "failure",
        "own_kind",
        "category",
        "provider_detail",
        "external",
        F.when(external, P.external_description(F.col("category"), F.col("provider_detail")))
        .when(failure, P.failure_description())
        .alias("description"),
        "error_identity",
        F.when(failure, F.col("file_path")).alias("file_path"),
        passed.alias("proves"),
        proof.alias("proof"),
        F.when(~failure | F.col("ok"), P.signal_description()).alias("signal_description"),
    )


def _candidates(facts: DataFrame) -> DataFrame:
    """Each fact once per problem group it opens, extends or closes."""
    same = (
        facts.where(F.col("own_kind").isin(*ISLAND_KINDS))
        .withColumn("kind", F.col("own_kind"))
        .withColumn(
            "cmd",
            F.when(F.col("kind") == "command-failure", F.coalesce("command", F.lit(_NO_COMMAND))).otherwise(""),
        )
        .withColumn("same", F.lit(True))
    )
    passed = (
        facts.withColumn("kind", F.explode(F.filter("proves", lambda k: k.isin(*ISLAND_KINDS))))
        .where(~F.col("failure") | (F.col("own_kind") != F.col("kind")))
        .withColumn("cmd", F.when(F.col("kind") == "command-failure", F.col("command")).otherwise(""))
        .withColumn("same", F.lit(False))
    )
    ends = facts.where("type = 'SESSION_COMPLETED'").withColumn("same", F.lit(False))
    groups = same.select(*GROUP).distinct()
    ended = ends.join(groups, ["session_id", "family"]).select(*same.columns)
    return same.unionByName(passed.select(*same.columns)).unionByName(ended)


_OPENER = ["ts_ms", "input_index", "id", "agent_id", "type", "category", "provider_detail", "description", "error_identity", "file_path"]
_CLOSER = ["ts_ms", "input_index", "id", "signal_description", "proof", "type"]


def _island_problems(facts: DataFrame) -> DataFrame:
    rows = stage(
        ordered_scan(
            _candidates(facts), GROUP, ORDER, time_chunk(), island=running_sum((~F.col("same")).cast("int"), inclusive=False)
        ).drop("command", "meta_task", "proves", "failure", "own_kind")
    )
    opens = F.col("same") & ~F.col("external")
    key = [*GROUP, "island"]
    islands = rows.groupBy(*key).agg(
        F.min(F.when(opens, F.struct(*_OPENER))).alias("o"),
        F.count_if("same").alias("n"),
        F.min(F.when(~F.col("same"), F.struct(*_CLOSER))).alias("c"),
    )
    # External failures before the opener stand alone; only such rows come back for the check.
    outside = rows.where("same and external").select(*key, *_OPENER)
    early = outside.join(islands.select(*key, F.struct("o.ts_ms", "o.input_index").alias("_open"), F.col("o").isNull().alias("_none")), key).where(
        F.col("_none") | (position() < F.col("_open"))
    )
    before = early.groupBy(*key).agg(F.count("*").alias("n_before"))
    merged = (
        islands.where("o is not null")
        .join(before, key, "left")
        .select(
            "session_id", "family", "kind", "o.*",
            (F.col("n") - F.coalesce("n_before", F.lit(0))).alias("attempts"),
            F.lit(False).alias("alone"),
            F.col("c").alias("closer"),
        )
    )
    alone = early.select(
        "session_id", "family", "kind", *_OPENER,
        F.lit(1).cast("bigint").alias("attempts"), F.lit(True).alias("alone"),
        F.lit(None).cast(merged.schema["closer"].dataType).alias("closer"),
    )
    return merged.unionByName(alone)


def _fold_opener(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sorted groups with constant state: the open problem, if any."""
    group, current = None, None
    out: list[dict] = []

    def close(closer=None):
        nonlocal current
        if current is not None:
            out.append({**current, "closer": closer})
        current = None

    for pdf in batches:
        for row in pdf.to_dict("records"):
            key = (row["session_id"], row["family"], row["kind"])
            if key != group:
                close()
                group = key
            if row["same"]:
                if current is not None:
                    current["attempts"] += 1
                elif row["external"]:
                    out.append({**_opened(row), "alone": True, "closer": None})
                else:
                    current = _opened(row)
                    match = (row["command"], row["task"])
                continue
            if current is None:
                continue
            if row["type"] == "SESSION_COMPLETED":
                hit = True
            elif row["kind"] == "agent-failure":
                hit = row["type"] in P.AGENT_START and match[1] is not None and row["meta_task"] == match[1]
            else:
                hit = row["type"] == "COMMAND_COMPLETED" and match[0] is not None and row["command"] == match[0]
            if hit:
                close({c: row[c] for c in _CLOSER})
        if len(out) > 10_000:
            yield pd.DataFrame(out)
            out = []
    close()
    if out:
        yield pd.DataFrame(out)


def _opened(row: dict) -> dict:
    kept = {c: row[c] for c in ("session_id", "family", "kind", *_OPENER)}
    return {**kept, "attempts": 1, "alone": False}


def _opener_problems(facts: DataFrame, agent_tasks: DataFrame, like: DataFrame) -> DataFrame:
    """Kinds whose recovery depends on the command or task of the opener: timeout, abort, agent failure.

    Truly sequential, so these rare rows alone are folded, in constant memory. Signals of groups
    without such a failure are dropped before the shuffle of the fold.
    """
    kinds = ("timeout", "abort", "agent-failure")
    same = (
        facts.where(F.col("own_kind").isin(*kinds))
        .withColumn("kind", F.col("own_kind"))
        .withColumn("same", F.lit(True))
        .join(agent_tasks, ["session_id", "agent_id"], "left")
    )
    groups = same.select("session_id", "family", "kind").distinct()
    signals = (
        facts.where(F.col("type").isin("SESSION_COMPLETED", *P.AGENT_START) | F.exists("proves", lambda k: k.isin("timeout", "abort")))
        .join(groups, ["session_id", "family"])
        .where(
            (F.col("type") == "SESSION_COMPLETED")
            | ((F.col("kind") == "agent-failure") & F.col("type").isin(*P.AGENT_START) & F.col("meta_task").isNotNull())
            | ((F.col("kind") != "agent-failure") & (F.col("type") == "COMMAND_COMPLETED"))
        )
        .where(~F.col("failure") | (F.col("own_kind") != F.col("kind")))
        .withColumn("same", F.lit(False))
        .withColumn("task", F.lit(None).cast("string"))
    )
    cols = ["session_id", "family", "kind", *dict.fromkeys(_OPENER + _CLOSER), "same", "external", "command", "task", "meta_task"]
    rows = same.select(*cols).unionByName(signals.select(*cols))
    return (
        rows.repartition("session_id", "family", "kind")
        .sortWithinPartitions("session_id", "family", "kind", *ORDER)
        .mapInPandas(_fold_opener, like.schema)
    )


def detect_problems(events: DataFrame, families: DataFrame, agents: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """One row per problem: opener, attempts, recovery signal, status. ``events`` need no family yet."""
    from .sessions import with_family

    # Read by every branch below, and much narrower than the events: written once.
    facts = stage(_facts(with_family(events, families)))
    merged = _island_problems(facts)
    tasks = agents.select("session_id", "agent_id", F.col("task_summary").alias("task"))
    found = merged.unionByName(_opener_problems(facts, tasks, merged))
    proof = F.coalesce(F.col("closer.proof"), F.lit(False))
    found = found.select(
        *[c for c in found.columns if c != "closer"],
        F.when(proof, F.col("closer.id")).alias("signal_event_id"),
        F.when(proof, F.col("closer.ts_ms")).alias("signal_ms"),
        F.when(proof, F.col("closer.signal_description")).alias("signal_description"),
        F.when(proof, F.col("closer.type")).alias("signal_type"),
        F.col("closer.ts_ms").alias("_end_ms"),
        F.col("closer.input_index").alias("_end_index"),
    )
    return problem_status(found, running).withColumnRenamed("id", "event_id")


def problem_status(found: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """RECOVERED on a proof of the same kind, POSSIBLY_RECOVERED on another, else by liveness.

    ``running`` must hold only sessions without a recorded end.
    """
    if running is not None:
        live = running.select("session_id").distinct().withColumn("_live", F.lit(True))
        found = found.join(live, "session_id", "left")
    else:
        found = found.withColumn("_live", F.lit(False))
    live = F.coalesce("_live", F.lit(False))
    kind, signal = F.col("kind"), F.col("signal_type")
    strong = (
        ((kind == "test-failure") & (signal == "TEST_PASSED"))
        | ((kind == "build-failure") & (signal == "BUILD_PASSED"))
        | (kind.isin("command-failure", "timeout", "abort") & (signal == "COMMAND_COMPLETED"))
        | (kind == "agent-failure")
    )
    status = (
        F.when(F.col("alone"), F.when(live, "PENDING").otherwise("BLOCKED"))
        .when(signal.isNotNull(), F.when(strong, "RECOVERED").otherwise("POSSIBLY_RECOVERED"))
        .when(live, "PENDING")
        .otherwise("UNRESOLVED")
    )
    return found.withColumn("status", status).drop("_live")


def number_problems(problems: DataFrame) -> DataFrame:
    return ordered_scan(problems, ["session_id"], ORDER, time_chunk(), problem_no=running_sum(F.lit(1)))


def _work_counts(events: DataFrame, families: DataFrame) -> DataFrame:
    """Every event with the number of follow-up steps its family had made up to it."""
    from .sessions import with_family

    step = F.col("type").isin(*FOLLOW_UP_TYPES)
    facts = with_family(events, families).select(
        "session_id", "family", *ORDER, "id", step.alias("step"), "file_path", F.when(step, P.follow_up_description()).alias("description")
    )
    return ordered_scan(facts, ["session_id", "family"], ORDER, time_chunk(), ordinal=running_sum(F.col("step").cast("int")))


def follow_up_spans(events: DataFrame, families: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problems with the ordinals of their first and last follow-up, and the numbered steps.

    The steps between failure and signal are a range of ordinals, so counting them is a subtraction
    and listing the first twelve is an equi-join; no interval join runs.
    """
    counted = _work_counts(events, families)
    marks = counted.select("session_id", "input_index", F.col("ordinal"))
    totals = counted.groupBy("session_id", "family").agg(F.max("ordinal").alias("_all"))
    spans = (
        problems.where("not alone")
        .join(marks.withColumnRenamed("ordinal", "_open"), ["session_id", "input_index"])
        .join(marks.select("session_id", F.col("input_index").alias("_end_index"), F.col("ordinal").alias("_close")), ["session_id", "_end_index"], "left")
        .join(totals, ["session_id", "family"])
        .withColumn("first_step", F.col("_open") + 1)
        .withColumn("last_step", F.coalesce("_close", "_all"))
        .drop("_open", "_close", "_all")
    )
    return spans, counted.where("step")


def follow_ups(spans: DataFrame, steps: DataFrame, cap: int = 12) -> DataFrame:
    """The first ``cap`` follow-up steps of each problem with its total number of steps."""
    total = F.greatest(F.col("last_step") - F.col("first_step") + 1, F.lit(0))
    wanted = spans.where("last_step >= first_step").select(
        "session_id",
        "family",
        "event_id",
        total.alias("follow_up_count"),
        F.col("first_step"),
        F.explode(F.sequence("first_step", F.least(F.col("first_step") + (cap - 1), F.col("last_step")))).alias("ordinal"),
    )
    return wanted.join(
        steps.select("session_id", "family", "ordinal", F.col("id").alias("step_event_id"), F.col("ts_ms").alias("step_ms"), "description"),
        ["session_id", "family", "ordinal"],
    ).select(
        "session_id", "event_id", "follow_up_count", (F.col("ordinal") - F.col("first_step") + 1).alias("step_no"),
        "step_event_id", "step_ms", "description",
    )


def file_involvement(files: DataFrame, spans: DataFrame, steps: DataFrame) -> DataFrame:
    """Flag files touched in the follow-up of any problem, or named by a failure with an identity.

    A step is inside some span when the spans opened up to it outnumber those closed before it, which
    is a running sum over ordinals; no span is joined to its steps.
    """
    moves = spans.where("last_step >= first_step").select(
        "session_id",
        "family",
        F.inline(
            F.array(
                F.struct(F.col("first_step").alias("ordinal"), F.lit(1).alias("move"), F.lit(0).alias("pass")),
                F.struct((F.col("last_step") + 1).alias("ordinal"), F.lit(-1).alias("move"), F.lit(0).alias("pass")),
            )
        ),
    )
    moves = moves.groupBy("session_id", "family", "ordinal", "pass").agg(F.sum("move").alias("move"))
    moves = moves.withColumn("path", F.lit(None).cast("string"))
    walk = steps.select(
        "session_id", "family", "ordinal", F.lit(1).alias("pass"), F.lit(0).cast("bigint").alias("move"), F.col("file_path").alias("path")
    )
    depth = ordered_scan(
        moves.unionByName(walk), ["session_id", "family"], ["ordinal", "pass"], sequence_chunk("ordinal"), depth=running_sum(F.col("move"))
    )
    worked = depth.where("pass = 1 and depth > 0 and path is not null").select("session_id", "path")
    named = spans.where("error_identity is not null and file_path is not null").select("session_id", F.col("file_path").alias("path"))
    hit = worked.union(named).distinct().withColumn("_hit", F.lit(True))
    return (
        files.join(hit, ["session_id", "path"], "left")
        .withColumn("involved_in_problems", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def problems_only(events: DataFrame, problems: DataFrame, steps: DataFrame) -> DataFrame:
    """Ids that stay in the problems-only view.

    Problem, follow-up and signal events, all their ancestors, the session's start and end, and the
    later children of kept events. Parent chains are short (result → call), so each closure is a few
    rounds over a shrinking frontier, with lineage cut in every round.
    """
    links = events.select("session_id", "id", "parent_id", *ORDER)
    seeds = (
        problems.select("session_id", F.col("event_id").alias("id"))
        .union(problems.where("signal_event_id is not null").select("session_id", "signal_event_id"))
        .union(steps.select("session_id", "step_event_id"))
        .distinct()
    )
    kept = stage(seeds)
    frontier = kept
    while True:
        frontier = stage(
            frontier.join(links.where("parent_id is not null").select("session_id", "id", "parent_id"), ["session_id", "id"])
            .select("session_id", F.col("parent_id").alias("id"))
            .distinct()
            .join(kept, ["session_id", "id"], "left_anti")
        )
        if frontier.isEmpty():
            break
        kept = kept.unionByName(frontier)
    # A child joins when its parent is already kept as the timeline is walked forward. The seeds count
    # from the start (position null), everything added by the walk only for later events.
    none = F.lit(None).cast("bigint")
    bounds = links.join(events.where(F.col("type").isin("SESSION_STARTED", "SESSION_COMPLETED")).select("session_id", "id"), ["session_id", "id"], "left_semi")
    reached = kept.select("session_id", "id", none.alias("p_ms"), none.alias("p_idx")).unionByName(
        bounds.join(kept, ["session_id", "id"], "left_anti").select(
            "session_id", "id", F.col("ts_ms").alias("p_ms"), F.col("input_index").alias("p_idx")
        )
    )
    reached = stage(reached)
    frontier, done = reached, reached.select("session_id", "id")
    children = links.where("parent_id is not null")
    while True:
        frontier = stage(
            children.join(frontier.withColumnRenamed("id", "parent_id"), ["session_id", "parent_id"])
            .where(F.col("p_ms").isNull() | (F.struct("p_ms", "p_idx") < position()))
            .groupBy("session_id", "id")
            .agg(F.first("ts_ms").alias("p_ms"), F.first("input_index").alias("p_idx"))
            .join(done, ["session_id", "id"], "left_anti")
        )
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier.select("session_id", "id"))
    return links.join(done, ["session_id", "id"], "left_semi").select("session_id", "id", *ORDER)
