"""Session level operators: lifecycle, task, agents, files, outcome, attention, lists.

Input is one row per session event (see ``tracelake.schemas.SESSION_EVENT``). Aggregates are plain
``groupBy`` with ``min_by``/``max_by`` over the order (ts_ms, input_index), so they combine before
the shuffle and a hot session does no harm. Lists whose length grows with a session (files of an
agent, agents of a file, children) are rows, not arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import problems as P
from ..functions.text import ellipsis, first_line, is_task_shaped, short_task
from ..runtime import stage
from .ordered import ordered_scan, running_sum, time_chunk

ORDER = ["ts_ms", "input_index"]
# Event types that show coding work.
CODING_TYPES = (
    "FILE_READ", "FILE_CREATED", "FILE_CHANGED", "FILE_DELETED", "COMMAND_STARTED", "COMMAND_COMPLETED",
    "TEST_STARTED", "TEST_PASSED", "TEST_FAILED", "BUILD_STARTED", "BUILD_PASSED", "BUILD_FAILED",
    "TOOL_CALLED", "TOOL_RESULT",
)
TIER_LABELS = {
    1: "BLOCKED", 2: "FAILED", 3: "RECOVERY IN PROGRESS", 4: "RUNNING · HAD PROBLEMS", 5: "RUNNING", 6: "IDLE",
}
DAY_MS = 86_400_000


def position() -> Column:
    return F.struct(*ORDER)


def at(where: Column | None = None) -> Column:
    """Ordering value for ``min_by``/``max_by``; rows outside ``where`` are ignored."""
    return position() if where is None else F.when(where, position())


def agent() -> Column:
    return F.coalesce(F.col("agent_id"), F.lit("main"))


def index_events(events: DataFrame) -> DataFrame:
    """Position in the session and offset from its first event."""
    start = events.groupBy("session_id").agg(F.min("ts_ms").alias("_start"))
    numbered = ordered_scan(events, ["session_id"], ORDER, time_chunk(), position=running_sum(F.lit(1)))
    return numbered.join(start, "session_id").withColumn("offset_ms", F.col("ts_ms") - F.col("_start")).drop("_start")


def session_lifecycle(events: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """One row per session: source, project, status, start, end, duration, declared outcome.

    ``running`` lists the session ids the caller has evidence to be live.
    """
    done = F.col("type") == "SESSION_COMPLETED"
    declared = F.coalesce("meta_outcome", "meta_status")
    segments = F.filter(F.split(F.regexp_replace("meta_cwd", r"[\\]+", "/"), "/"), lambda s: s != "")
    project = F.when(F.col("type") == "SESSION_STARTED", F.try_element_at(segments, F.lit(-1)))
    out = events.groupBy("session_id").agg(
        F.min_by("source", at(F.col("source").isNotNull())).alias("source"),
        F.min_by(project, at(project.isNotNull())).alias("project"),
        F.bool_or(done).alias("_completed"),
        F.min("ts_ms").alias("started_ms"),
        F.max(F.when(done, F.col("ts_ms"))).alias("_done_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.max_by(declared, at(done & declared.isNotNull())).alias("declared_outcome"),
        F.count("*").alias("events"),
    )
    if running is not None:
        live = running.select("session_id").distinct().withColumn("_live", F.lit(True))
        out = out.join(live, "session_id", "left")
    else:
        out = out.withColumn("_live", F.lit(False))
    ended = F.coalesce("_done_ms", "last_ms")
    return out.select(
        "session_id",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        "project",
        F.when(F.col("_completed"), "COMPLETED")
        .when(F.col("_live"), "RUNNING")
        .otherwise("UNKNOWN")
        .alias("session_status"),
        F.coalesce("_live", F.lit(False)).alias("running"),
        "started_ms",
        ended.alias("ended_ms"),
        F.greatest(F.lit(0), ended - F.col("started_ms")).alias("duration_ms"),
        "last_ms",
        "declared_outcome",
        "events",
    )


def session_task(events: DataFrame) -> DataFrame:
    """What the session was asked: a short user task, else a long one, else any first message.

    A message seen before the short task also counts for the last fallback, so order decides only
    within each of the three groups.
    """
    said = (F.col("type") == "MESSAGE") & (F.length("summary") > 0)
    asked = said & (F.col("meta_role") == "user") & is_task_shaped(F.col("summary"))
    short = asked & (F.length("summary") <= 200)
    return (
        events.groupBy("session_id")
        .agg(
            F.min_by("summary", at(short)).alias("_short"),
            F.min_by("summary", at(asked)).alias("_long"),
            F.min_by("summary", at(said)).alias("_any"),
        )
        .select("session_id", short_task(F.coalesce("_short", "_long", "_any")).alias("task"))
    )


def agent_starts(events: DataFrame) -> DataFrame:
    """Start events that link an agent to another one."""
    parent = F.coalesce("parent_agent_id", F.lit("main"))
    return events.where(F.col("type").isin(*P.AGENT_START) & (F.col("agent_id") != parent)).select(
        "session_id", "agent_id", parent.alias("parent"), *ORDER
    )


def agent_graph(events: DataFrame) -> DataFrame:
    """One row per agent of a session, with parent, status, span and first task."""
    t, status = F.col("type"), F.col("status")
    starts, ends = t.isin(*P.AGENT_START), t.isin(*P.AGENT_END)
    state = (
        F.when(starts, "RUNNING")
        .when(ends & status.isin("error", "aborted", "timeout"), "FAILED")
        .when(ends & ((status == "ok") | (F.col("meta_outcome") == "success")), "SUCCESS")
        .when(ends, "UNKNOWN")
    )
    parent = F.coalesce("parent_agent_id", F.lit("main"))
    linked = starts & (F.col("agent_id") != parent)
    task = F.when(starts, F.col("meta_task")).when(t == "MESSAGE", short_task(F.col("summary")))
    seen = events.groupBy("session_id", agent().alias("agent_id")).agg(
        F.max_by(parent, at(linked)).alias("parent_agent_id"),
        F.max_by(state, at(state.isNotNull())).alias("status"),
        F.min_by(task, at(task.isNotNull())).alias("task_summary"),
        F.min("ts_ms").alias("started_ms"),
        F.max("ts_ms").alias("ended_ms"),
        F.count("*").alias("event_count"),
    )
    # A parent that produced no event of its own is still a node.
    parents = agent_starts(events).select("session_id", F.col("parent").alias("agent_id")).distinct()
    return seen.join(parents, ["session_id", "agent_id"], "full").select(
        "session_id",
        "agent_id",
        "parent_agent_id",
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        "task_summary",
        "started_ms",
        "ended_ms",
        F.greatest(F.lit(0), F.col("ended_ms") - F.col("started_ms")).alias("duration_ms"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
    )


def agent_items(events: DataFrame) -> DataFrame:
    """Distinct files written, commands run and error identities per agent, with first position."""
    t = F.col("type")
    error = F.when(
        P.is_failure() & ~t.isin("COMMAND_COMPLETED", "TOOL_RESULT"),
        F.coalesce(first_line(F.col("error")), P.failure_description()),
    )
    items = F.array(
        F.struct(F.lit("file").alias("item"), F.when(t.isin(*P.WRITES), F.col("file_path")).alias("value")),
        F.struct(
            F.lit("command").alias("item"),
            F.when(t.isin("COMMAND_STARTED", "COMMAND_COMPLETED"), F.col("command")).alias("value"),
        ),
        F.struct(F.lit("error").alias("item"), error.alias("value")),
    )
    return (
        events.select("session_id", agent().alias("agent_id"), *ORDER, F.inline(F.filter(items, lambda i: i["value"].isNotNull())))
        .groupBy("session_id", "agent_id", "item", "value")
        .agg(F.min(position()).alias("_first"))
        .select("session_id", "agent_id", "item", "value", "_first.ts_ms", "_first.input_index")
    )


def agent_children(events: DataFrame) -> DataFrame:
    """Parent/child pairs of agents in order of first start."""
    return (
        agent_starts(events)
        .groupBy("session_id", "parent", "agent_id")
        .agg(F.min(position()).alias("_first"))
        .select("session_id", F.col("parent").alias("agent_id"), F.col("agent_id").alias("child"), "_first.ts_ms", "_first.input_index")
    )


def root_agent(events: DataFrame) -> DataFrame:
    """``main`` when it exists (as an agent or as a parent), else the agent of the first event."""
    parent_main = F.col("type").isin(*P.AGENT_START) & (F.coalesce("parent_agent_id", F.lit("main")) == "main") & (
        F.col("agent_id") != "main"
    )
    return events.groupBy("session_id").agg(
        F.when(F.bool_or((agent() == "main") | F.coalesce(parent_main, F.lit(False))), F.lit("main"))
        .otherwise(F.min_by(agent(), position()))
        .alias("root_agent_id")
    )


def settle_root(agents: DataFrame, roots: DataFrame, outcome: DataFrame) -> DataFrame:
    """A root agent without a verdict of its own takes the outcome of a completed session."""
    facts = roots.join(outcome.select("session_id", "session_status", "outcome"), "session_id")
    inherits = (
        (F.col("agent_id") == F.col("root_agent_id"))
        & (F.col("status") == "UNKNOWN")
        & (F.col("session_status") == "COMPLETED")
    )
    settled = F.when(inherits & F.col("outcome").isin("SUCCESS", "FAILED"), F.col("outcome")).otherwise(F.col("status"))
    return agents.join(facts, "session_id").withColumn("status", settled).select(*agents.columns)


def agent_families(events: DataFrame) -> DataFrame:
    """Family label of every agent that is linked to another one (an unlinked agent is its own).

    The parent link is a function, so pointer doubling finds the end of each chain in log2(longest
    chain) joins over the link frame, which holds agents and not events. A cycle of declared parents
    has no end: there the least id on the cycle is the label.
    """
    nodes = (
        agent_starts(events)
        .groupBy("session_id", "agent_id")
        .agg(F.max_by("parent", position()).alias("ptr"))
    )
    loose = (
        nodes.select("session_id", F.col("ptr").alias("agent_id"))
        .join(nodes.select("session_id", "agent_id"), ["session_id", "agent_id"], "left_anti")
        .distinct()
        .withColumn("ptr", F.col("agent_id"))
    )
    graph = stage(nodes.unionByName(loose).withColumn("low", F.least("agent_id", "ptr")))
    widest = graph.groupBy("session_id").count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, (int(widest) - 1).bit_length())
    for done in range(rounds):
        hop = graph.select("session_id", F.col("agent_id").alias("ptr"), F.col("ptr").alias("_ptr2"), F.col("low").alias("_low2"))
        graph = graph.join(hop, ["session_id", "ptr"]).select(
            "session_id", "agent_id", F.col("_ptr2").alias("ptr"), F.least("low", "_low2").alias("low")
        )
        if done % 3 == 2:
            graph = stage(graph)
    ends = graph.select("session_id", F.col("agent_id").alias("ptr"), F.col("low").alias("_end_low"))
    # On a chain the end points to itself and its low is itself; on a cycle low is the cycle minimum.
    return graph.join(ends, ["session_id", "ptr"]).select("session_id", "agent_id", F.col("_end_low").alias("family"))


def with_family(events: DataFrame, families: DataFrame) -> DataFrame:
    return (
        events.withColumn("_agent", agent())
        .join(families.withColumnRenamed("agent_id", "_agent"), ["session_id", "_agent"], "left")
        .withColumn("family", F.coalesce("family", "_agent"))
        .drop("_agent")
    )


def file_touches(events: DataFrame) -> DataFrame:
    """One row per session and path."""
    t = F.col("type")
    return (
        events.where(F.col("file_path").isNotNull())
        .groupBy("session_id", F.col("file_path").alias("path"))
        .agg(
            F.count_if(t == "FILE_CREATED").alias("created"),
            F.count_if(t == "FILE_CHANGED").alias("changed"),
            F.count_if(t == "FILE_DELETED").alias("deleted"),
            F.count_if(t == "FILE_READ").alias("reads"),
            F.count_if(t.isin(*P.WRITES)).alias("edits"),
            F.sum("meta_additions").alias("additions"),
            F.sum("meta_deletions").alias("deletions"),
            F.min_by(agent(), position()).alias("first_touched_by"),
            F.max_by(agent(), position()).alias("last_touched_by"),
            F.min("ts_ms").alias("first_ms"),
            F.max("ts_ms").alias("last_ms"),
        )
    )


def file_agents(events: DataFrame) -> DataFrame:
    """Agents of a file with the position of their first touch."""
    return (
        events.where(F.col("file_path").isNotNull())
        .groupBy("session_id", F.col("file_path").alias("path"), agent().alias("agent_id"))
        .agg(F.min(position()).alias("_first"))
        .select("session_id", "path", "agent_id", "_first.ts_ms", "_first.input_index")
    )


def session_outcome(events: DataFrame, lifecycle: DataFrame, problems: DataFrame, agents: DataFrame) -> DataFrame:
    """Counters of a session and its outcome; a declared outcome wins over the evidence."""
    t = F.col("type")
    path = F.when(t.isin(*P.WRITES) & (F.col("file_path") != ""), F.col("file_path"))
    counts = events.groupBy("session_id").agg(
        F.count_distinct(path).alias("files_changed"),
        F.count_if(t == "TEST_PASSED").alias("tests_passed"),
        F.count_if(t == "TEST_FAILED").alias("tests_failed"),
        F.count_if(t == "BUILD_PASSED").alias("builds_passed"),
        F.count_if(t == "BUILD_FAILED").alias("builds_failed"),
        F.count_if(t == "COMMAND_COMPLETED").alias("commands_run"),
        F.count_if((t == "COMMAND_COMPLETED") & P.is_failure()).alias("commands_failed"),
    )
    status = F.col("status")
    tally = problems.groupBy("session_id").agg(
        F.count("*").alias("problems"),
        F.sum("attempts").alias("failures"),
        F.count_if(status.isin("RECOVERED", "POSSIBLY_RECOVERED")).alias("recovered"),
        F.count_if(status == "UNRESOLVED").alias("unresolved"),
        F.count_if(status == "BLOCKED").alias("blocked"),
    )
    heads = agents.groupBy("session_id").agg(F.count("*").alias("agents"))
    said = F.col("declared_outcome")
    verdict = (
        F.when(said == "success", "SUCCESS")
        .when(said.isin("failure", "error"), "FAILED")
        .when(said.isin("blocked", "stopped"), "BLOCKED")
        .when(said == "partial", "PARTIAL")
        .when(said.isNotNull() | (F.col("session_status") != "COMPLETED"), "UNKNOWN")
        .when(F.col("unresolved") > 0, "FAILED")
        .when(F.col("blocked") > 0, "BLOCKED")
        .when(F.col("recovered") == F.col("problems"), "SUCCESS")
        .otherwise("PARTIAL")
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("problems", "failures", "recovered", "unresolved", "blocked", "agents")}
    return (
        lifecycle.join(counts, "session_id")
        .join(tally, "session_id", "left")
        .join(heads, "session_id", "left")
        .withColumns(zero)
        .withColumn("outcome", verdict)
    )


def coding_sessions(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.bool_or(F.col("type").isin(*CODING_TYPES)).alias("coding"))


def last_observed(events: DataFrame) -> DataFrame:
    """Latest humanized action, else the latest summary or error."""
    label = P.last_observed_text()
    summary = F.when(
        ~F.col("type").isin("SESSION_STARTED", "SESSION_COMPLETED"),
        F.when(F.length("summary") > 0, ellipsis(F.trim(F.regexp_replace("summary", r"\s+", " ")), 60)).when(
            F.col("type") == "ERROR", "reported an error"
        ),
    )
    return events.groupBy("session_id").agg(
        F.coalesce(
            F.max_by(label, at(label.isNotNull())), F.max_by(summary, at(summary.isNotNull()))
        ).alias("last_observed")
    )


def attention(problems: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Attention tier 1 to 6 with the headline problem. Sessions without problems take part."""
    status = F.col("status")
    external = F.col("category").isin("PROVIDER", "ENVIRONMENT")
    waiting = status.isin("PENDING", "POSSIBLY_RECOVERED")
    head = F.struct("category", "provider_detail", F.col("description").alias("summary"), "status")

    def first(where):
        return F.min_by(head, at(where))

    tally = problems.groupBy("session_id").agg(
        F.count("*").alias("_n"),
        first(status == "BLOCKED").alias("_blocked"),
        first(external).alias("_external"),
        first(status == "UNRESOLVED").alias("_unresolved"),
        first(waiting).alias("_waiting"),
    )
    live = F.col("running")
    tier = (
        F.when(F.col("_blocked").isNotNull() | (live & F.col("_external").isNotNull()), 1)
        .when(F.col("_unresolved").isNotNull(), 2)
        .when(live & F.col("_waiting").isNotNull(), 3)
        .when(live & (F.col("_n") > 0), 4)
        .when(live, 5)
        .otherwise(6)
    )
    headline = (
        F.when(F.col("tier") == 1, F.coalesce("_blocked", "_external"))
        .when(F.col("tier") == 2, F.col("_unresolved"))
        .when(F.col("tier") == 3, F.col("_waiting"))
    )
    label = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_LABELS.items() for x in kv]), F.col("tier"))
    return (
        lifecycle.select("session_id", "running")
        .join(tally, "session_id", "left")
        .withColumn("tier", tier)
        .withColumn("_head", headline)
        .select(
            "session_id",
            "tier",
            label.alias("label"),
            F.col("_head.category").alias("problem_category"),
            F.col("_head.provider_detail").alias("provider_detail"),
            F.col("_head.summary").alias("problem_summary"),
            F.when(F.col("tier") == 1, "BLOCKED")
            .when(F.col("tier") == 2, "UNRESOLVED")
            .when(F.col("tier") == 3, "RECOVERY IN PROGRESS")
            .alias("recovery_state"),
        )
    )


def attention_sort_key(tier: Column, last_ms: Column, now_ms: int) -> Column:
    return tier.cast("double") * 1e15 + F.greatest(F.lit(0), F.lit(now_ms) - last_ms)


def radar(sessions: DataFrame, clear_rows: int = 12) -> DataFrame:
    """Coding sessions: all that need attention (tier up to 3), then the ``clear_rows`` best of the rest."""
    coding = sessions.where("coding")
    needs = coding.where("tier <= 3").withColumn("section", F.lit("needs attention"))
    clear = (
        coding.where("tier > 3")
        .orderBy("tier", F.col("last_ms").desc(), "session_id")
        .limit(clear_rows)
        .withColumn("section", F.lit("everything else"))
    )
    return needs.unionByName(clear)


def liveness(files: DataFrame, lifecycle: DataFrame, now_ms: int, window_ms: int = 120_000) -> DataFrame:
    """A session is running when its file changed within the window and no end was recorded."""
    return files.join(lifecycle.select("session_id", "session_status"), "session_id").select(
        "session_id",
        ((F.lit(now_ms) - F.col("modified_ms") <= window_ms) & (F.col("session_status") != "COMPLETED")).alias("running"),
    )


def session_list(
    outcome: DataFrame, tasks: DataFrame, tiers: DataFrame, observed: DataFrame, coding: DataFrame
) -> DataFrame:
    """One flat row per session for lists and the radar."""
    return (
        outcome.join(tasks, "session_id")
        .join(tiers, "session_id")
        .join(observed, "session_id")
        .join(coding, "session_id")
        .select(
            "session_id",
            F.coalesce("task", "session_id").alias("label"),
            "project",
            "coding",
            F.when(F.col("running"), "RUNNING").otherwise(F.col("outcome")).alias("status"),
            "running",
            "tier",
            F.col("label").alias("attention_label"),
            "problem_category",
            "problem_summary",
            "recovery_state",
            "last_observed",
            "duration_ms",
            "last_ms",
            "problems",
            "recovered",
            "unresolved",
            "agents",
            "files_changed",
            "source",
        )
    )


def filter_list(rows: DataFrame, status: str = "all", query: str = "") -> DataFrame:
    """Status filter (all, success, failed, running, problems) and substring search on label and id."""
    wanted = {
        "success": F.col("status") == "SUCCESS",
        "failed": F.col("status").isin("FAILED", "PARTIAL"),
        "running": F.col("status") == "RUNNING",
        "problems": F.col("problems") > 0,
    }.get(status)
    if wanted is not None:
        rows = rows.where(wanted)
    q = query.strip().lower()
    if q:
        rows = rows.where(F.contains(F.lower("label"), F.lit(q)) | F.contains(F.lower("session_id"), F.lit(q)))
    return rows


def day_groups(rows: DataFrame, today_ms: int) -> DataFrame:
    """Heading per row: Today, Yesterday or Earlier. Empty headings have no rows."""
    ms = F.coalesce("last_ms", F.lit(0))
    return rows.withColumn(
        "heading",
        F.when(ms >= today_ms, "Today").when(ms >= today_ms - DAY_MS, "Yesterday").otherwise("Earlier"),
    )


def progress_steps(tasks: DataFrame, problems: DataFrame, agents: DataFrame, outcome: DataFrame) -> DataFrame:
    """Milestones of a session: task, problems with their recovery, running agent, outcome."""
    zero = F.lit(0).cast("bigint")

    def rows(df, group, ms, idx, glyph, label, detail=None):
        return df.select(
            "session_id",
            F.lit(group).alias("step_group"),
            ms.alias("at_ms"),
            idx.alias("at_index"),
            glyph.alias("glyph"),
            label.alias("label"),
            (detail if detail is not None else F.lit(None).cast("string")).alias("detail"),
        )

    task = rows(tasks.where("task is not null"), 0, zero, zero, F.lit("○"), F.col("task"))
    failed = rows(problems, 1, F.col("ts_ms"), F.col("input_index") * 2, F.lit("✕"), F.col("description"))
    fixed = rows(
        problems.where(F.col("status").isin("RECOVERED", "POSSIBLY_RECOVERED")),
        1,
        F.col("ts_ms"),
        F.col("input_index") * 2 + 1,
        F.lit("↻"),
        F.concat(F.lit("Recovery: "), F.coalesce("signal_description", F.lit("signal observed"))),
        F.concat(F.col("attempts").cast("string"), F.when(F.col("attempts") == 1, " attempt").otherwise(" attempts")),
    )
    last = agents.groupBy("session_id").agg(
        F.max_by(F.struct("agent_id", "status"), F.struct(F.coalesce("started_ms", F.lit(0)), "agent_id")).alias("a")
    )
    live = rows(
        last.join(outcome.where("session_status = 'RUNNING'").select("session_id"), "session_id").where(
            "a.status = 'RUNNING'"
        ),
        2, zero, zero, F.lit("●"), F.concat(F.col("a.agent_id"), F.lit(" running")),
    )
    end = rows(
        outcome.where("outcome <> 'UNKNOWN'"), 3, zero, zero,
        F.when(F.col("outcome") == "FAILED", "✕").otherwise("✓"), F.concat(F.lit("Outcome: "), F.col("outcome")),
    )
    steps = task.unionByName(failed).unionByName(fixed).unionByName(live).unionByName(end)
    bare = rows(
        outcome.join(steps.select("session_id").distinct(), "session_id", "left_anti"), 4, zero, zero,
        F.lit("●"), F.lit("Session activity recorded"),
    )
    return steps.unionByName(bare)
