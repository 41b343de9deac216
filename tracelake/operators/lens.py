"""Mode lens, projections, topology and checkpoints of analysed answers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ASSESSMENT_WORDS, infer_mode
from ..runtime import stage
from .evidence import grounded  # noqa: F401  (part of the analysis vocabulary)
from .ordered import fold_groups, last_seen, ordered_scan, running_sum, sequence_chunk

STALE_DAYS = 3 * 366


def observed_mode(scoped: DataFrame, claims: DataFrame) -> DataFrame:
    """Mode shown by what was done, most telling activity first."""
    t = F.col("type")
    counts = scoped.groupBy("aid").agg(
        F.count_if(t == "COMPARE").alias("c"), F.count_if(t.isin("VERIFY", "CONTRADICTION")).alias("v"), F.count_if(t == "RECOMMEND").alias("r"),
        F.count_if(t == "SEARCH").alias("s"), F.bool_or(t.isin("CLAIM", "READ")).alias("x"),
    )
    words = claims.groupBy("aid").agg(F.bool_or(F.lower("text").rlike(ASSESSMENT_WORDS)).alias("a"))
    mode = (
        F.when(F.col("c") > 0, "COMPARE").when(F.col("v") > 0, "VERIFY").when(F.col("r") > 0, "DECIDE").when(F.col("s") >= 4, "IDEATE")
        .when(F.col("a"), "ASSESS").when(F.col("x"), "EXPLAIN").otherwise("UNKNOWN")
    )
    return counts.join(words, "aid", "left").select("aid", mode.alias("observed"))


def lens(answers: DataFrame, observed: DataFrame, scoped: DataFrame) -> DataFrame:
    """Current mode and freshness flag. ``answers``: aid, question, override (null for none)."""
    dated = r"(?i)\b(202\d|latest|recent|current|today|fresh)\b"
    asked = scoped.where("type = 'SEARCH'").groupBy("aid").agg(F.bool_or(F.col("search.query").rlike(dated)).alias("_dated"))
    base = answers.join(observed, "aid", "left").join(asked, "aid", "left").withColumn("observed", F.coalesce("observed", F.lit("UNKNOWN")))
    base = base.withColumn("hypothesis", infer_mode(F.nullif("question", F.lit(""))))
    seen = F.when(F.col("observed") != "UNKNOWN", F.col("observed")).otherwise(F.col("hypothesis"))
    base = base.withColumn("_seen", seen).withColumn("_forced", F.coalesce(F.col("override") != F.col("_seen"), F.lit(False)))
    mode = F.when(F.col("_forced"), F.col("override")).otherwise(F.col("_seen"))
    fresh = F.coalesce(F.col("question").rlike(dated), F.lit(False)) | F.coalesce("_dated", F.lit(False))
    return base.withColumn("mode", mode).select(
        "aid", "hypothesis", "observed", "override", F.col("_forced").alias("forced"), "mode",
        F.when((F.col("mode") == "ASSESS") | fresh, "FRESHNESS_SENSITIVE").otherwise("NONE").alias("temporal"),
    )


def lens_revisions(state: DataFrame) -> DataFrame:
    """Hypothesis, then confirmation or correction, then override: one row per step taken."""
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("INITIAL_HYPOTHESIS").alias("phase"), F.col("hypothesis").alias("mode")),
        F.when(
            F.col("observed") != "UNKNOWN",
            F.struct(F.lit(2).alias("step"), F.when(F.col("observed") == F.col("hypothesis"), "OBSERVED_CONFIRMATION").otherwise("OBSERVED_CORRECTION").alias("phase"), F.col("observed").alias("mode")),
        ),
        F.when(F.col("forced"), F.struct(F.lit(3).alias("step"), F.lit("EXPLICIT_OVERRIDE").alias("phase"), F.col("override").alias("mode"))),
    )
    return state.select("aid", F.inline(F.filter(steps, lambda s: s.isNotNull())))


def freshness(published: DataFrame, state: DataFrame, scoped: DataFrame) -> DataFrame:
    """Oldest publication date against the last event. ``published``: aid, published_ms."""
    oldest = published.groupBy("aid").agg(F.min("published_ms").alias("_old"))
    last = scoped.groupBy("aid").agg(F.max_by("occurred_ms", "sequence").alias("_ref"))
    age = (F.col("_ref") - F.col("_old")) / 86_400_000
    return state.select("aid", "temporal").join(oldest, "aid", "left").join(last, "aid", "left").select(
        "aid",
        F.when(F.col("_old").isNull(), F.when(F.col("temporal") == "FRESHNESS_SENSITIVE", "UNKNOWN").otherwise("NOT_APPLICABLE"))
        .when(F.col("_ref").isNull(), "UNKNOWN").when(age > STALE_DAYS, "STALE").otherwise("CURRENT").alias("freshness"),
    )


def explain(claims: DataFrame) -> DataFrame:
    return claims.select("aid", "claim_id", F.when(F.col("text").rlike("(?i)how|structure|architecture|contain|consist|build"), "STRUCTURE").otherwise("CAUSAL").alias("group"))


def assess(claims: DataFrame) -> DataFrame:
    return claims.select("aid", "claim_id", F.when(F.col("text").rlike("(?i)risk|fail|vulnerability|threat|flaw"), "RISK").otherwise("FEASIBILITY").alias("group"))


def compare_matrix(scoped: DataFrame) -> DataFrame:
    """One row per compared cell, with its claim when it has a value."""
    cells = scoped.where("type = 'COMPARE'").select("aid", "event_id", F.posexplode("compare.cells").alias("pos", "cell"))
    claim = F.concat(F.lit("claim-"), "event_id", F.lit("-"), "cell.candidate", F.lit("-"), "cell.criterion")
    return cells.select(
        "aid", "event_id", "pos", "cell.candidate", "cell.criterion", "cell.value",
        F.when(F.col("cell.value").isNotNull(), claim).alias("claim_id"), F.size("cell.evidence_event_ids").alias("evidence"),
    )


def choices(scoped: DataFrame) -> DataFrame:
    """The last choice per answer, and how often it was advised."""
    return scoped.where("type = 'RECOMMEND'").groupBy("aid").agg(F.max_by("recommend.choice", "sequence").alias("choice"), F.count("*").alias("recommendations"))


def decide(scoped: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last choice per answer, and each rejected option with the supported claims that mention it.

    Options are matched through the words of claims: an option is looked up by its first word among
    the words of the answer's claims, then checked in full, so claims and options are not all paired.
    """
    advice = scoped.where("type = 'RECOMMEND'")
    options = advice.select("aid", "event_id", F.explode("recommend.alternatives").alias("option"))
    needle = F.lower("option")
    probe = options.select("aid", "option").distinct().withColumn("gram", F.substring(needle, 1, 3)).where("gram <> ''")
    sizes = probe.groupBy("aid").agg(F.collect_set(F.length("gram")).alias("_sizes"))
    texts = verdicts.where("supporting > 0").select(
        "aid", "claim_id", F.lower("text").alias("_text"), F.concat(F.lower("text"), F.lit("\n"), F.lower("claim_id")).alias("_all")
    )
    # Each claim becomes many rows of runs, which no size estimate sees: they carry no text, and the joins on them are never broadcast.
    places = F.sequence(F.lit(1), F.length("_all"))
    grams = texts.join(sizes.hint("merge"), "aid").select(
        "aid", "claim_id", F.explode(F.array_distinct(F.flatten(F.transform("_sizes", lambda n: F.transform(places, lambda p: F.substring("_all", p, n)))))).alias("gram"),
    )
    met = probe.hint("merge").join(grams, ["aid", "gram"]).select("aid", "option", "claim_id").distinct()
    named = F.contains("_text", needle) | F.contains("claim_id", F.concat(F.lit("-"), "option", F.lit("-")))
    found = met.hint("merge").join(texts.drop("_all"), ["aid", "claim_id"]).where(named).select("aid", "option", "claim_id").distinct()
    return choices(scoped), options.join(found.hint("merge"), ["aid", "option"], "left").select("aid", "event_id", "option", "claim_id")


def verify_ledger(checks: DataFrame, found: DataFrame) -> DataFrame:
    return checks.select("aid", F.lit("VERIFICATION").alias("row"), F.col("event_id").alias("id"), F.col("correctness").alias("status")).unionByName(
        found.select("aid", F.lit("CONFLICT").alias("row"), F.col("conflict_id").alias("id"), "status")
    )


def overview(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Every claim, whatever its verdict, and the conflicts that are not resolved."""
    return claims.select("aid", F.lit("CLAIM").alias("row"), F.col("claim_id").alias("id")).unionByName(
        found.where("status <> 'RESOLVED'").select("aid", F.lit("OPEN_CONFLICT").alias("row"), F.col("conflict_id").alias("id"))
    )


def with_branch(scoped: DataFrame, whole: bool = False) -> DataFrame:
    """Events with the number and id of the branch they belong to; before the first search there is none."""
    search = F.col("type") == "SEARCH"
    narrow = scoped.select("aid", "event_id", "sequence", "type", "occurred_ms")
    return ordered_scan(
        narrow, ["aid"], ["sequence"], sequence_chunk(), whole,
        branch=running_sum(search.cast("int")), branch_event=last_seen(F.col("event_id"), search, inclusive=True), prev=last_seen(F.struct("event_id", "type")),
    )


def ideate(branched: DataFrame, scoped: DataFrame) -> DataFrame:
    """Branches with their size; the last is ACTIVE. Without any search the whole answer is one branch."""
    last = branched.groupBy("aid").agg(F.max("branch").alias("_last"))
    queries = scoped.where("type = 'SEARCH'").groupBy("aid").agg(F.count_distinct(F.lower(F.trim("search.query"))).alias("_q"))
    rows = branched.join(last, "aid").where("branch > 0 or _last = 0")
    return (
        rows.groupBy("aid", "branch", "branch_event", "_last").agg(F.count("*").alias("events"))
        .join(queries, "aid", "left")
        .select(
            "aid", F.coalesce(F.concat(F.lit("branch-"), "branch_event"), F.lit("branch-main")).alias("branch_id"), "events",
            F.when(F.col("branch") == F.col("_last"), "ACTIVE").otherwise("UNKNOWN").alias("status"),
            F.when(F.col("_q") > 1, "OBSERVED").otherwise("UNKNOWN").alias("diversity"),
        )
    )


def activity_nodes(scoped: DataFrame) -> DataFrame:
    by_type = scoped.groupBy("aid", "type").agg(F.count("*").alias("events"))
    activity = by_type.select(
        "aid", F.concat(F.lit("node-activity-"), F.lower("type")).alias("node_id"), F.lit("ACTIVITY").alias("kind"),
        F.concat("type", F.lit(" Activity ("), F.col("events").cast("string"), F.lit(")")).alias("label"), "events",
    )
    queries = scoped.where("type = 'SEARCH'").select(
        "aid", F.concat(F.lit("node-query-"), "event_id").alias("node_id"), F.lit("QUERY_CLUSTER").alias("kind"),
        F.concat(F.lit("Query: "), F.substring(F.coalesce("search.query", F.lit("search")), 1, 40)).alias("label"), F.lit(1).cast("bigint").alias("events"),
    )
    return activity.unionByName(queries)


def _branch_node(number: Column, event: Column) -> Column:
    return F.concat(F.lit("node-branch-"), number.cast("string"), F.lit("-"), event)


def branches(branched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """BRANCH nodes, and their edges to their query and to the branch before."""
    rows = branched.where("branch > 0").groupBy("aid", "branch", "branch_event").agg(F.count("*").alias("events"))
    node = _branch_node(F.col("branch"), F.col("branch_event"))
    nodes = rows.select(
        "aid", node.alias("node_id"), F.lit("BRANCH").alias("kind"),
        F.concat(F.lit("Inferred branch "), F.col("branch").cast("string"), F.lit(" (from SEARCH boundary)")).alias("label"), "events",
    )
    to_query = rows.select("aid", node.alias("from_node"), F.concat(F.lit("node-query-"), "branch_event").alias("to_node"), F.lit("INFERRED_BRANCH").alias("kind"))
    # Branch numbers are dense, so the branch before is an equi-join, not a window.
    before = rows.select("aid", (F.col("branch") + 1).alias("branch"), _branch_node(F.col("branch"), F.col("branch_event")).alias("from_node"))
    follow = rows.join(before, ["aid", "branch"]).select("aid", "from_node", node.alias("to_node"), F.lit("INFERRED_BRANCH").alias("kind"))
    return nodes, to_query.unionByName(follow)


def event_sources(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """The source an event is filed under: the last ledger entry it is an anchor of."""
    entry = sources.select("aid", "key", F.struct("first", "source").alias("_e"))
    of = ["aid", "event_id", "sequence", "type"]
    return refs.select(*of, "key").join(entry, ["aid", "key"]).groupBy(*of).agg(F.max("_e").alias("_e")).select(*of, F.col("_e.source").alias("source"))


def facets(filed: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """FACET nodes: searches filed under one source, numbered by first search; edges to each search."""
    searches = filed.where("type = 'SEARCH'").select("aid", "event_id", "sequence", "source")
    groups = searches.groupBy("aid", "source").agg(F.min("sequence").alias("sequence"), F.count("*").alias("events"))
    numbered = ordered_scan(groups, ["aid"], ["sequence", "source"], sequence_chunk(), whole, facet=running_sum(F.lit(1)))
    node = F.concat(F.lit("node-facet-"), F.col("facet").cast("string"), F.lit("-"), "source")
    nodes = numbered.select("aid", node.alias("node_id"), F.lit("FACET").alias("kind"), F.concat(F.lit("Facet: sources shared with "), "source").alias("label"), "events", "source")
    edges = searches.join(nodes.select("aid", "source", "node_id"), ["aid", "source"]).select(
        "aid", F.col("node_id").alias("from_node"), F.concat(F.lit("node-query-"), "event_id").alias("to_node"), F.lit("INFERRED_BRANCH").alias("kind")
    )
    return nodes.drop("source"), edges


def sequence_edges(branched: DataFrame) -> DataFrame:
    return branched.where("prev is not null").select(
        "aid", F.concat_ws("-", F.lit("edge-seq"), F.col("prev.event_id"), "event_id").alias("edge_id"),
        F.concat(F.lit("node-activity-"), F.lower("prev.type")).alias("from_node"), F.concat(F.lit("node-activity-"), F.lower("type")).alias("to_node"),
        F.lit("OBSERVED_SEQUENCE").alias("kind"),
    )


def shared_source_edges(branched: DataFrame, filed: DataFrame, whole: bool = False) -> DataFrame:
    """Branches that use one source, each linked to the next one only; every pair once."""
    used = branched.where("branch > 0").select("aid", "event_id", "branch", "branch_event").join(filed.select("aid", "event_id", "source"), ["aid", "event_id"]).select("aid", "source", "branch", "branch_event").distinct()
    linked = ordered_scan(used, ["aid", "source"], ["branch"], sequence_chunk("branch"), whole, prev=last_seen(F.struct("branch", "branch_event")))
    return linked.where("prev is not null").select(
        "aid", _branch_node(F.col("prev.branch"), F.col("prev.branch_event")).alias("from_node"), _branch_node(F.col("branch"), F.col("branch_event")).alias("to_node"),
        F.lit("SHARED_SOURCE").alias("kind"),
    ).distinct()


def concentration(scoped: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Largest share of one activity type, and of one source (reads or mentions)."""
    total = scoped.groupBy("aid").agg(F.count("*").alias("denominator"))
    activity = scoped.groupBy("aid", "type").count().groupBy("aid").agg(F.max("count").alias("numerator")).withColumn("meaning", F.lit("OBSERVED_ACTIVITY_SHARE"))
    reads = evidence.where("type = 'READ' and source is not null").groupBy("aid", "source").count().groupBy("aid").agg(F.max("count").alias("_reads"))
    share = (
        sources.groupBy("aid").agg(F.max("anchors").alias("_anchors")).join(reads, "aid", "left")
        .select("aid", F.greatest("_anchors", F.coalesce("_reads", F.lit(0))).alias("numerator"), F.lit("SOURCE_SHARE").alias("meaning"))
    )
    return activity.unionByName(share.select("aid", "numerator", "meaning")).join(total, "aid").select("aid", "meaning", "numerator", "denominator")


def duration_frontier(branched: DataFrame) -> DataFrame:
    """Time from the first to the last event (null when negative), and where observation ends."""
    span = F.max_by("occurred_ms", "sequence") - F.min_by("occurred_ms", "sequence")
    last = F.max_by(F.struct("event_id", "type", "branch", "branch_event"), "sequence")
    return branched.groupBy("aid").agg(span.alias("_span"), F.min_by("event_id", "sequence").alias("start_event"), last.alias("_l")).select(
        "aid", F.when(F.col("_span") >= 0, F.col("_span")).alias("duration_ms"), "start_event", F.col("_l.event_id").alias("end_event"),
        F.concat(F.lit("node-activity-"), F.lower("_l.type")).alias("frontier_activity"),
        F.when(F.col("_l.branch") > 0, _branch_node(F.col("_l.branch"), F.col("_l.branch_event"))).alias("frontier_branch"),
    )


def tree_delta(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], collapse: int = 3) -> DataFrame:
    """Rows of ``after`` that are new or whose values changed since ``before``; large rows are marked collapsed."""
    old = before.select(*keys, F.struct(*values).alias("_old"))
    joined = after.join(old, keys, "left")
    changed = F.when(F.col("_old").isNull(), "NEW").when(~F.struct(*values).eqNullSafe(F.col("_old")), "CHANGED")
    out = joined.withColumn("change", changed).where("change is not null").drop("_old")
    return out.withColumn("collapsed", F.col("events") >= collapse) if "events" in after.columns else out


CHECKPOINT_BUDGET, RESERVED, COOLDOWN, NO_GAIN_WINDOW = 10, 2, 3, 4
CONCENTRATION_READS, CONCENTRATION_SHARE = 3, 0.6
HIGH = ("CONTRADICTION", "PRE_RECOMMENDATION")


def checkpoint_triggers(scoped: DataFrame, evidence: DataFrame, whole: bool = False) -> DataFrame:
    """Events that may become a checkpoint, with the facts the selection needs."""
    base = evidence.select("aid", "event_id", "sequence", "type", F.coalesce("source", F.lit("unknown")).alias("source"), "admissibility")
    read = F.col("type") == "READ"
    seen = stage(ordered_scan(
        base, ["aid"], ["sequence"], sequence_chunk(), whole,
        reads=running_sum(read.cast("int")), prev=last_seen(F.struct("event_id", "sequence")),
        gain_seq=last_seen(F.col("sequence"), F.col("admissibility") == "ADMISSIBLE", inclusive=True),
    ))
    per_source = ordered_scan(seen.where(read), ["aid", "source"], ["sequence"], sequence_chunk(), whole, own_reads=running_sum(F.lit(1))).select("aid", "event_id", "own_reads")
    rows = seen.join(per_source, ["aid", "event_id"], "left")
    crowded = read & (F.col("reads") >= CONCENTRATION_READS) & (F.col("own_reads") / F.col("reads") >= CONCENTRATION_SHARE)
    stalled = F.col("gain_seq").isNotNull() & (F.col("sequence") - F.col("gain_seq") >= NO_GAIN_WINDOW)
    fixed = F.filter(
        F.array(
            F.when(F.col("type") == "CONTRADICTION", "CONTRADICTION"), F.when(F.col("type").isin("SEARCH", "HYPOTHESIS"), "NEW_BRANCH"),
            F.when(crowded, "SOURCE_CONCENTRATION_THRESHOLD"), F.when(F.lit(False), ""),
        ),
        lambda x: x.isNotNull(),
    )
    advice = (F.col("type") == "RECOMMEND") & F.col("prev").isNotNull()
    return rows.select(
        "aid", "event_id", "sequence", "admissibility", fixed.alias("fixed"), F.coalesce(stalled, F.lit(False)).alias("stalled"), advice.alias("advice"),
        "gain_seq", F.col("prev.event_id").alias("prev_event"), F.col("prev.sequence").alias("prev_seq"),
    ).where((F.size("fixed") > 0) | F.col("stalled") | F.col("advice"))


def _select(key: tuple, rows: list[dict], budget: int, cooldown: int) -> list[tuple]:
    """Spend the budget of one answer over its candidates in order."""
    picked, low, high, last, fired_for, keys = [], 0, 0, -999, None, set()
    for r in rows:
        triggers = list(r["fixed"])
        stalled = bool(r["stalled"]) and fired_for != r["gain_seq"]
        triggers += ["NO_EVIDENCE_GAIN_WINDOW"] * stalled + ["PRE_RECOMMENDATION"] * bool(r["advice"])
        if not triggers:
            continue
        urgent = any(t in HIGH for t in triggers)
        if low + high >= budget or (not urgent and low >= budget - RESERVED):
            continue
        event, at = (r["prev_event"], r["prev_seq"]) if r["advice"] else (r["event_id"], r["sequence"])
        if not urgent and at - last < cooldown:
            continue
        if (triggers[0], at) in keys:
            continue
        keys.add((triggers[0], at))
        if stalled:
            fired_for = r["gain_seq"]
        picked.append((key[0], low + high + 1, event, int(at), r["event_id"], ",".join(triggers), max(0, int(last))))
        low, high, last = low + (not urgent), high + urgent, at
    return picked


def select_checkpoints(scoped: DataFrame, evidence: DataFrame, budget: int = CHECKPOINT_BUDGET, cooldown: int = COOLDOWN, whole: bool = False) -> DataFrame:
    """At most ``budget`` checkpoints per answer.

    The budget bounds what can matter. Urgent candidates are chosen until it is spent. A plain one is passed over only
    if it lies within the cooldown of a choice or repeats the place of one, so ``budget`` choices pass over
    ``cooldown`` + 1 each at most; the same holds for the rows of stalled stretches and for the stretches. Rows beyond
    can never be chosen, so each answer's selection runs over a bounded number of rows.
    """
    most = budget * (cooldown + 3)
    cand = stage(checkpoint_triggers(scoped, evidence, whole))
    urgent = F.col("advice") | F.array_contains("fixed", "CONTRADICTION")
    plain = ~urgent & (F.size("fixed") > 0)
    lone = ~urgent & (F.size("fixed") == 0)
    ranked = ordered_scan(cand, ["aid"], ["sequence"], sequence_chunk(), whole, _u=running_sum(urgent.cast("int")), _p=running_sum(plain.cast("int")))
    kept = ranked.where((urgent & (F.col("_u") <= budget)) | (plain & (F.col("_p") <= most))).drop("_u", "_p")
    stalls = ordered_scan(cand.where(lone), ["aid", "gain_seq"], ["sequence"], sequence_chunk(), whole, _r=running_sum(F.lit(1)))
    windows = ordered_scan(stalls.where("_r = 1").select("aid", "gain_seq"), ["aid"], ["gain_seq"], sequence_chunk("gain_seq"), whole, _w=running_sum(F.lit(1)))
    first = stalls.where(F.col("_r") <= most).join(windows.where(F.col("_w") <= most), ["aid", "gain_seq"]).select(*kept.columns)
    return fold_groups(
        kept.unionByName(first), ["aid"], ["sequence"], partial(_select, budget=budget, cooldown=cooldown), "aid string, ordinal bigint, anchor_event string, anchor_seq bigint, source_event string, triggers string, from_seq bigint"
    )


def advisory_labels(checkpoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """Gain, progress and rethink labels from the evidence of the triggering event."""
    item = evidence.select("aid", F.col("event_id").alias("source_event"), (F.col("admissibility") == "ADMISSIBLE").alias("_gain"))
    has = {t: F.contains("triggers", F.lit(t)) for t in ("CONTRADICTION", "SOURCE_CONCENTRATION_THRESHOLD", "NO_EVIDENCE_GAIN_WINDOW")}
    gain = F.coalesce("_gain", F.lit(False))

    def yes(c):
        return F.when(c, "YES").otherwise("NO")

    return checkpoints.join(item, ["aid", "source_event"], "left").select(
        "aid", "ordinal", "anchor_event", "triggers", yes(gain).alias("evidence_gain"), yes(gain & ~has["CONTRADICTION"]).alias("progress"),
        yes(has["CONTRADICTION"] | (has["SOURCE_CONCENTRATION_THRESHOLD"] & has["NO_EVIDENCE_GAIN_WINDOW"])).alias("rethink"),
    )


def mark_stale(results: DataFrame, revisions: DataFrame) -> DataFrame:
    """Results whose answer has moved on from ``revision`` become STALE; they are kept."""
    current = revisions.select("aid", F.col("revision").alias("_current"))
    return results.join(current, "aid", "left").withColumn(
        "status", F.when(F.col("revision").eqNullSafe(F.col("_current")), F.col("status")).otherwise("STALE")
    ).drop("_current")
