"""Evidence analysis of answers: sources, evidence, claims, conflicts, verifications, support.

All frames carry ``aid`` (the answer scope under analysis); every answer of the input is analysed at
once. Events are ordered by ``sequence`` within an answer, and what an event may know is what came
before it, so the as-of rules are sequence comparisons on joins.

Scoped event columns: aid, run_id, event_id, sequence, type, occurred_ms, category (REPORTED, OBSERVED,
INFERRED), has_locator, source struct, relations array, and one nullable payload struct per type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import let
from ..functions.conditions import parse_condition
from ..functions.urls import archive_embedded_location, normalize_location
from ..runtime import stage
from .ingest import cycle_edges
from .ordered import ordered_scan, running_min, sequence_chunk

_REF = ("source_id", "kind", "location", "content_hash", "title", "accessed_at")


def scope_events(events: DataFrame, answers: DataFrame, scope: DataFrame) -> DataFrame:
    """Events of each answer: its own and shared ids, or the whole run when it declared no boundary."""
    declared = answers.where("scope_declared").select(F.col("receipt_id").alias("aid"), "run_id")
    ids = scope.select(F.col("receipt_id").alias("aid"), "event_id").distinct()
    # The size of events is guessed from packed columns; a broadcast on such a guess fills the driver.
    exact = ids.join(declared, "aid").join(events.hint("merge"), ["run_id", "event_id"])
    open_ended = answers.where("not scope_declared").select(F.col("receipt_id").alias("aid"), "run_id")
    whole = events.join(open_ended, "run_id")
    return exact.unionByName(whole.select(*exact.columns))


def scope_boundary(answers: DataFrame, scope: DataFrame) -> DataFrame:
    own = scope.where("scope = 'own'").select("receipt_id").distinct().withColumn("_own", F.lit(True))
    return answers.join(own, "receipt_id", "left").select(
        F.col("receipt_id").alias("aid"), "run_id",
        F.when(F.col("scope_declared") & F.col("_own"), "EXACT").otherwise("UNKNOWN").alias("boundary"),
    )


def _src(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("src-")), c).otherwise(F.concat(F.lit("src-"), c))


def with_refs(events: DataFrame) -> DataFrame:
    """Events with the array ``refs`` of the sources that each names, with their spelling and key.

    Best before events are scoped, as an event is in several answers.
    """
    own = F.when(F.col("source.source_id").isNotNull(), F.struct(*[F.col(f"source.{c}").alias(c) for c in _REF]))
    none = F.lit(None).cast("string")
    hits = F.transform(
        F.coalesce(F.col("search.results"), F.array().cast("array<struct<source_id:string,title:string,url:string,rank:int>>")),
        lambda r: F.struct(
            r["source_id"].alias("source_id"), F.lit("URL").alias("kind"), r["url"].alias("location"),
            none.alias("content_hash"), r["title"].alias("title"), none.alias("accessed_at"),
        ),
    )

    def named(s, normalized):
        key = F.coalesce(F.concat(F.lit("loc:"), normalized), F.concat(F.lit("hash:"), F.nullif(s["content_hash"], F.lit(""))), F.concat(F.lit("id:"), s["source_id"]))
        return F.struct(*[s[c].alias(c) for c in _REF], normalized.alias("normalized"), key.alias("key"))

    given = F.filter(F.concat(F.array(own), hits), lambda s: s.isNotNull())
    return events.withColumn("refs", F.transform(given, lambda s: let(normalize_location(s["location"], s["kind"]), lambda n: named(s, n))))


def source_refs(scoped: DataFrame) -> DataFrame:
    """One row per source an event names: its own source, then its search results. ``asks`` marks the first of each key in an event with a query."""
    rows = scoped if "refs" in scoped.columns else with_refs(scoped)
    query = F.nullif(F.trim("search.query"), F.lit(""))
    # The outer form, since Spark guards the other one by a filter that works out the array again.
    each = rows.select("aid", "event_id", "sequence", "type", query.alias("query"), "refs", F.posexplode_outer("refs").alias("pos", "s")).where("pos is not null")
    first = F.array_position(F.transform("refs", lambda s: s["key"]), F.col("s.key")) == F.col("pos") + 1
    asks = F.when(F.col("query").isNotNull(), F.coalesce(first, F.lit(False))).otherwise(F.lit(False))
    return each.select("aid", "event_id", "sequence", "type", "query", "pos", "s.*", asks.alias("asks"))


def source_captures(refs: DataFrame) -> DataFrame:
    """One row per source and id it was captured under, with the first mention of the pair."""
    at = (F.col("sequence"), F.col("pos"))
    return refs.groupBy("aid", "key", "source_id").agg(
        F.min(F.struct(*at, "kind", "location")).alias("named"),
        F.max("normalized").alias("normalized"),
        F.min(F.when(F.col("title") != "", F.struct(*at, "title"))).alias("titled"),
        F.min(F.when(F.col("accessed_at") != "", F.struct(*at, "accessed_at"))).alias("accessed"),
        F.count("*").alias("anchors"),
        F.count_if("asks").alias("queries"),
    )


def source_ledger(captures: DataFrame) -> DataFrame:
    """One row per source; the first mention names it. Captured ids, queries and anchors stay in ``refs``."""
    named = F.struct("named.sequence", "named.pos", "source_id", "named.kind", "named.location")
    rows = captures.groupBy("aid", "key").agg(
        F.min(named).alias("n"), F.max("normalized").alias("normalized"), F.min("titled").alias("t"), F.min("accessed").alias("a"),
        F.sum("anchors").alias("anchors"), F.count("source_id").alias("captured_ids"), F.sum("queries").alias("queries"),
    )
    return rows.select(
        "aid", "key", F.struct("n.sequence", "n.pos").alias("first"), _src(F.col("n.source_id")).alias("source"), "n.kind", "n.location", "normalized",
        "t.title", F.when(F.col("t").isNotNull(), F.struct("t.sequence", "t.pos")).alias("titled"), "a.accessed_at", "anchors", "captured_ids", "queries",
    )


def flag_spoof(sources: DataFrame) -> DataFrame:
    """A title, or a role in an array ``roles`` if there is one, that claims to be official on an address or host that cannot be."""
    host = F.regexp_extract("normalized", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    # Official words, and hosts that contradict them.
    bad = host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") | F.contains(host, F.lit("spoof")) | F.contains(host, F.lit("fake-mirror"))
    claims = F.col("title").rlike("(?i)official|canonical|authoritative")
    if "roles" in sources.columns:
        claims = F.coalesce(claims, F.lit(False)) | F.arrays_overlap("roles", F.array(F.lit("OFFICIAL"), F.lit("PRIMARY")))
    return sources.withColumn("spoof", F.coalesce(bad & claims, F.lit(False)))


def flag_mirrors(sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Identity of each source: mirror of the earliest earlier one with the same content or inside an archive.

    The earliest holder of each content hash is aggregated first, so sources that share a hash are
    joined to one row and never to each other.
    """
    me = F.struct("first", "source")
    hashes = refs.where("content_hash <> ''").select("aid", "key", "content_hash").distinct()
    held = hashes.join(sources.select("aid", "key", me.alias("_me")), ["aid", "key"])
    first_holder = held.groupBy("aid", "content_hash").agg(F.min("_me").alias("_earliest"))
    same = held.join(first_holder, ["aid", "content_hash"]).where("_earliest.first < _me.first").select("aid", "key", "_earliest")
    inner = archive_embedded_location(F.col("normalized"))
    archived = (
        sources.where(F.contains("normalized", F.lit("archive.org")))
        .select("aid", "key", F.col("first").alias("_mine"), inner.alias("_inner"))
        .where("_inner is not null")
        .join(sources.select("aid", F.col("normalized").alias("_inner"), me.alias("_earliest")), ["aid", "_inner"])
        .where("_earliest.first < _mine")
        .select("aid", "key", "_earliest")
    )
    found = same.unionByName(archived).groupBy("aid", "key").agg(F.min("_earliest").alias("_of"))
    out = sources.join(found, ["aid", "key"], "left")
    mirror = F.col("_of").isNotNull() & ~F.col("spoof")
    return out.select(
        *sources.columns,
        F.when(F.coalesce(F.nullif("location", F.lit("")), F.col("normalized")).isNull(), "UNKNOWN")
        .when(F.col("spoof"), "SPOOF_SUSPECTED").when(mirror, "POSSIBLE_MIRROR").otherwise("MATCHED").alias("identity"),
        F.when(mirror, F.col("_of.source")).alias("mirror_of"),
    )


def canonical_sources(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Source of each captured id once everything is known: the first ledger entry that captured it."""
    entry = sources.select("aid", "key", F.struct("first", "source").alias("_e"))
    return (
        refs.select("aid", "key", "source_id").distinct().join(entry, ["aid", "key"])
        .groupBy("aid", "source_id").agg(F.min("_e").alias("_e"))
        .select("aid", "source_id", F.col("_e.source").alias("canonical"))
    )


def _effective() -> tuple[Column, Column]:
    """Whether an event claims to be observed without saying where, and the category that it has then."""
    forged = (F.col("category") == "OBSERVED") & ~F.col("has_locator")
    return forged, F.when(forged, "INFERRED").otherwise(F.col("category"))


def provenance(scoped: DataFrame) -> DataFrame:
    """Effective category of each event: that of its evidence item, which needs no source."""
    return scoped.select("aid", _effective()[1].alias("effective"))


def adjudicate(scoped: DataFrame, captures: DataFrame, sources: DataFrame, whole: bool = False) -> DataFrame:
    """One evidence item per event: integrity, admissibility and grounding, as known at the event.

    What is known of an id changes at the first capture of each of its sources only, so those and the events are scanned together.
    """
    entry = sources.select("aid", "key", F.struct("first", "source", "spoof", "titled").alias("_e"))
    events = scoped.select(
        "aid", F.col("source.source_id").alias("_sid"), "sequence", F.lit(1).alias("_own"), "run_id", "event_id", "type", "category", "has_locator",
        F.col("read.outcome").alias("_outcome"), F.lit(None).cast(entry.schema["_e"].dataType).alias("_e"),
    )
    learned = captures.where("source_id is not null").select("aid", "key", F.col("source_id").alias("_sid"), F.col("named.sequence").alias("sequence"), F.lit(0).alias("_own")).join(entry, ["aid", "key"]).drop("key")
    known = ordered_scan(
        events.where("_sid is not null").unionByName(learned, allowMissingColumns=True), ["aid", "_sid"], ["sequence", "_own"], sequence_chunk(), whole, _then=running_min(F.col("_e"))
    )
    rows = known.where("_own = 1").unionByName(events.where("_sid is null").withColumn("_then", F.col("_e")))
    read = F.col("type") == "READ"
    forged, effective = _effective()
    spoofed = F.coalesce(F.col("_then.spoof") & (F.col("_then.titled.sequence") <= F.col("sequence")), F.lit(False))
    integrity = (
        F.when(forged, "FORGED_OBSERVED").when(F.col("category") == "REPORTED", "REPORTED_ONLY")
        .when(read & F.col("_then").isNull(), "MISSING_ANCHOR").otherwise("ACCEPTED")
    )
    refused = (
        F.col("integrity").isin("FORGED_OBSERVED", "MISSING_ANCHOR") | spoofed
        | (read & F.coalesce(F.col("_outcome").isin("FAILED", "CANCELLED"), F.lit(False)))
        | (F.col("type").isin("CLAIM", "RECOMMEND") & (F.col("category") == "REPORTED"))
    )
    return (
        rows.withColumn("integrity", integrity)
        .withColumn("admissibility", F.when(refused, "INADMISSIBLE").otherwise("ADMISSIBLE"))
        .select(
            "aid", "run_id", "event_id", F.concat(F.lit("ev-"), "event_id").alias("evidence_id"), "sequence", "type",
            F.col("_then.source").alias("source"),
            F.col("category").alias("claimed"),
            effective.alias("effective"),
            "integrity",
            "admissibility",
            F.when(~read, "ACTIVITY_ONLY").when(F.col("_then").isNull(), "UNKNOWN")
            .when(F.col("admissibility") == "ADMISSIBLE", "SOURCE_CONTENT").otherwise("ACTIVITY_ONLY").alias("grounding"),
        )
    )


def grounded(evidence: DataFrame) -> DataFrame:
    return evidence.where("admissibility = 'ADMISSIBLE' and grounding = 'SOURCE_CONTENT'")


def condition_rows(scoped: DataFrame) -> DataFrame:
    """Parsed conditions of contradictions and of recommendations (the user's requirements)."""
    raw = scoped.where(F.col("type").isin("CONTRADICTION", "RECOMMEND")).select(
        "aid", "event_id", "sequence", "type",
        F.posexplode(F.when(F.col("type") == "CONTRADICTION", F.col("contradiction.conditions")).otherwise(F.col("recommend.user_conditions"))).alias("pos", "raw"),
    )
    return raw.withColumn("c", parse_condition(F.col("raw"))).select("aid", "event_id", "sequence", "type", "pos", "raw", "c.*")


def conditions(rows: DataFrame) -> DataFrame:
    """Distinct conditions, first registration wins; ``required`` marks user requirements."""
    at = F.struct("sequence", "pos")
    return rows.groupBy("aid", "id").agg(
        F.min_by(F.struct("dimension", "op", "value", "key"), at).alias("c"),
        F.bool_or(F.col("type") == "RECOMMEND").alias("required"),
        F.min(at).alias("_first"),
    ).select("aid", "id", "c.*", "required", F.col("_first.sequence").alias("sequence"))


def missing_conditions(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Required conditions that no admissible evidence carries."""
    carried = rows.where("type = 'CONTRADICTION'").join(
        evidence.where("admissibility = 'ADMISSIBLE'").select("aid", "event_id"), ["aid", "event_id"], "left_semi"
    )
    return rows.where("type = 'RECOMMEND'").select("aid", "id").distinct().join(carried.select("aid", "id"), ["aid", "id"], "left_anti")


def extract_claims(scoped: DataFrame) -> DataFrame:
    """Claims of CLAIM events, compared cells with a value, and recommendations."""
    base = ["aid", "event_id", "sequence", "category"]
    claim = scoped.where("type = 'CLAIM'").select(
        *base, F.lit("CLAIM").alias("kind"), F.concat(F.lit("claim-"), "event_id").alias("claim_id"), F.col("claim.text").alias("text"), F.lit(0).alias("pos"),
    )
    cells = scoped.where("type = 'COMPARE'").select(*base, F.posexplode("compare.cells").alias("pos", "cell")).where("cell.value is not null")
    cell = cells.select(
        *base, F.lit("COMPARE_CELL").alias("kind"),
        F.concat(F.lit("claim-"), "event_id", F.lit("-"), "cell.candidate", F.lit("-"), "cell.criterion").alias("claim_id"),
        F.concat(F.col("cell.candidate"), F.lit(" ["), F.col("cell.criterion"), F.lit("]: "), F.col("cell.value")).alias("text"), "pos",
    )
    choice = scoped.where("type = 'RECOMMEND'").select(
        *base, F.lit("RECOMMENDATION").alias("kind"), F.concat(F.lit("claim-"), "event_id", F.lit("-recommendation")).alias("claim_id"),
        F.concat(F.lit("Recommended: "), "recommend.choice").alias("text"), F.lit(0).alias("pos"),
    )
    return claim.unionByName(cell).unionByName(choice)


def claim_support(scoped: DataFrame, evidence: DataFrame, canonical: DataFrame) -> DataFrame:
    """Evidence rows for (SUPPORT) and against (OPPOSE) each claim."""
    good = grounded(evidence).select("aid", "event_id", "evidence_id", "source", "sequence")
    reads = good.groupBy("aid", "source").agg(F.min_by("evidence_id", "sequence").alias("evidence_id"))
    claims = scoped.where("type = 'CLAIM'").withColumn("claim_id", F.concat(F.lit("claim-"), "event_id"))
    cited = (
        claims.where("claim.source_id is not null").select("aid", "claim_id", F.col("claim.source_id").alias("source_id"))
        .join(canonical, ["aid", "source_id"], "left")
        .select("aid", "claim_id", F.coalesce("canonical", _src(F.col("source_id"))).alias("source"))
        .join(reads, ["aid", "source"])
        .select("aid", "claim_id", "evidence_id", F.lit("SUPPORT").alias("role"))
    )
    declared = claims.select("aid", "claim_id", F.inline("relations")).select("aid", "claim_id", "type", F.col("target_event_id").alias("event_id"))
    backed = declared.where("type = 'SUPPORTS'").join(good, ["aid", "event_id"]).select("aid", "claim_id", "evidence_id", F.lit("SUPPORT").alias("role"))
    usable = evidence.where("admissibility = 'ADMISSIBLE'").select("aid", "event_id", "evidence_id")
    opposed = declared.where("type = 'CONTRADICTS'").join(usable, ["aid", "event_id"]).select("aid", "claim_id", "evidence_id", F.lit("OPPOSE").alias("role"))
    cells = scoped.where("type = 'COMPARE'").select("aid", "event_id", F.explode("compare.cells").alias("cell")).where("cell.value is not null")
    listed = cells.select(
        "aid", F.concat(F.lit("claim-"), "event_id", F.lit("-"), "cell.candidate", F.lit("-"), "cell.criterion").alias("claim_id"),
        F.posexplode("cell.evidence_event_ids").alias("pos", "_eid"),
    ).withColumnRenamed("_eid", "event_id")
    # One item per source, the first listed; items without a source all count.
    per_source = (
        listed.join(good, ["aid", "event_id"])
        .withColumn("_one", F.coalesce("source", F.concat(F.lit("#"), F.col("pos").cast("string"))))
        .groupBy("aid", "claim_id", "_one").agg(F.min_by("evidence_id", "pos").alias("evidence_id"))
        .select("aid", "claim_id", "evidence_id", F.lit("SUPPORT").alias("role"))
    )
    first = cited.unionByName(backed).unionByName(opposed).unionByName(per_source).distinct()
    rationale = rationale_rows(scoped)
    direct = rationale.join(good, ["aid", "event_id"]).select("aid", "claim_id", "evidence_id", F.lit("SUPPORT").alias("role"))
    of_event = extract_claims(scoped).where("kind <> 'RECOMMENDATION'").select("aid", "event_id", F.col("claim_id").alias("_dep"))
    carried = (
        rationale.join(of_event, ["aid", "event_id"])
        .join(first.where("role = 'SUPPORT'").select("aid", F.col("claim_id").alias("_dep"), "evidence_id"), ["aid", "_dep"])
        .select("aid", "claim_id", "evidence_id", F.lit("SUPPORT").alias("role"))
    )
    return first.unionByName(direct.unionByName(carried).distinct())


def rationale_rows(scoped: DataFrame) -> DataFrame:
    return scoped.where("type = 'RECOMMEND'").select(
        "aid", F.concat(F.lit("claim-"), "event_id", F.lit("-recommendation")).alias("claim_id"),
        F.explode("recommend.rationale_event_ids").alias("_r"),
    ).withColumnRenamed("_r", "event_id")


def importance(claims: DataFrame, scoped: DataFrame) -> DataFrame:
    """CORE when the claim's event is part of a rationale, or when nothing was recommended."""
    reasons = rationale_rows(scoped).select("aid", "event_id").distinct().withColumn("_reason", F.lit(True))
    advised = scoped.where("type = 'RECOMMEND'").select("aid").distinct().withColumn("_advised", F.lit(True))
    return (
        claims.join(reasons, ["aid", "event_id"], "left").join(advised, "aid", "left")
        .withColumn("importance", F.when(F.col("_reason") | F.col("_advised").isNull(), "CORE").otherwise("SUPPORTING"))
        .drop("_reason", "_advised")
    )


def condition_match(scoped: DataFrame, rows: DataFrame) -> DataFrame:
    """Whether the conditions of a contradiction describe one circumstance."""
    own = rows.where("type = 'CONTRADICTION'")
    norm = F.regexp_replace(F.lower(F.trim("value")), r"\s+", " ")
    per_key = own.groupBy("aid", "event_id", "key").agg(
        F.count("*").alias("n"), F.count_distinct("op").alias("ops"), F.count_distinct(norm).alias("values"), F.min("pos").alias("first")
    )
    fails = F.when((F.col("n") > 1) & (F.col("ops") > 1), "UNKNOWN").when((F.col("n") > 1) & (F.col("values") > 1), "DIFFERENT")
    free = (F.col("key") == "other") & (F.col("op") == "EQ") & ~F.contains("value", F.lit("="))
    loose = own.groupBy("aid", "event_id").agg(F.count_if(free).alias("_loose"))
    first = per_key.groupBy("aid", "event_id").agg(F.min_by(fails, F.when(fails.isNotNull(), F.col("first"))).alias("_fail"))
    return (
        scoped.where("type = 'CONTRADICTION'").select("aid", "event_id", "sequence")
        .join(first, ["aid", "event_id"], "left").join(loose, ["aid", "event_id"], "left")
        .select("aid", "event_id", "sequence", F.coalesce("_fail", F.when(F.col("_loose") >= 2, "AMBIGUOUS"), F.lit("SAME")).alias("condition_match"))
    )


def conflict_targets(scoped: DataFrame) -> DataFrame:
    return scoped.where("type = 'CONTRADICTION'").select(
        "aid", F.col("event_id").alias("conflict_event"), F.col("sequence").alias("conflict_seq"),
        F.posexplode("contradiction.conflicting_event_ids").alias("pos", "_t"),
    ).withColumnRenamed("_t", "event_id")


def conflict_claims(scoped: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims under conflict: those known at the contradiction, CLAIM events that come later, else the raw ids."""
    targets = conflict_targets(scoped)
    hit = targets.join(claims.select("aid", "event_id", "claim_id", "kind", "sequence"), ["aid", "event_id"])
    before = F.col("sequence") < F.col("conflict_seq")
    kept = hit.where(before | (F.col("kind") == "CLAIM"))
    known = hit.where(before).select("aid", "conflict_event").distinct()
    bare = targets.join(known, ["aid", "conflict_event"], "left_anti").select("aid", "conflict_event", F.col("event_id").alias("claim_id"))
    return kept.select("aid", "conflict_event", "claim_id").unionByName(bare).distinct()


_GRAMS = (12, 4, 1)


def _claims_named(needles: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims whose text contains the wanted text and that came before it.

    A needle is looked up by its first characters among the character runs of the claims of the same
    answer, and only answers with such a needle are indexed; no claim meets every needle.
    """
    out = None
    for i, size in enumerate(_GRAMS):
        upper = _GRAMS[i - 1] if i else None
        part = needles.where((F.length("needle") >= size) & (F.lit(True) if upper is None else F.length("needle") < upper))
        part = part.withColumn("gram", F.substring("needle", 1, size))
        texts = claims.join(part.select("aid").distinct(), "aid", "left_semi").select("aid", "claim_id", F.col("sequence").alias("_cs"), F.lower("text").alias("_text"))
        texts = texts.where(F.length("_text") >= size)
        grams = texts.withColumn(
            "gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_text") - (size - 1)), lambda p: F.substring("_text", p, F.lit(size)))))
        )
        hit = part.join(grams, ["aid", "gram"]).where((F.col("_cs") < F.col("sequence")) & F.contains("_text", "needle")).select("aid", "event_id", "claim_id")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def verifications(scoped: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Assessment of each VERIFY: was its target known by then, and does grounded evidence back it."""
    v = _checks(scoped)
    needles = v.where("target_event_id is null and target_claim_text <> ''").select("aid", "event_id", "sequence", F.lower("target_claim_text").alias("needle"))
    hits = _claims_named(needles, claims).groupBy("aid", "event_id").agg(F.count("*").alias("_n"), F.min("claim_id").alias("claim_id"))
    by_text = needles.join(hits, ["aid", "event_id"], "left").select(
        "aid", "event_id",
        F.when(F.col("_n") == 1, "MATCHED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("MISMATCHED").alias("resolution"),
        F.when(F.col("_n") == 1, F.col("claim_id")).alias("claim_id"),
    )
    return _assessed(v, _resolved(v, scoped).unionByName(by_text), evidence)


def proofs(scoped: DataFrame, evidence: DataFrame) -> DataFrame:
    """The verifications that name their target by id, which are those that may resolve a conflict. No text is looked up."""
    v = _checks(scoped).where("target_event_id is not null")
    return _assessed(v, _resolved(v, scoped), evidence)


def _checks(scoped: DataFrame) -> DataFrame:
    return scoped.where("type = 'VERIFY'").select("aid", "event_id", "sequence", "verify.*")


def _resolved(v: DataFrame, scoped: DataFrame) -> DataFrame:
    """Targets given by id, and whether they were known by then."""
    known = scoped.select("aid", F.col("event_id").alias("target_event_id"), F.col("sequence").alias("_tseq"))
    return v.where("target_event_id is not null").join(known, ["aid", "target_event_id"], "left").select(
        "aid", "event_id", F.when(F.col("_tseq") < F.col("sequence"), "MATCHED").otherwise("MISSING").alias("resolution"), F.lit(None).cast("string").alias("claim_id")
    )


def _assessed(v: DataFrame, found: DataFrame, evidence: DataFrame) -> DataFrame:
    cited = v.select("aid", "event_id", "sequence", F.explode("evidence_event_ids").alias("_eid"))
    # An item is cited by its event's id or by its own, which is that with a prefix.
    bare = F.when(F.startswith("_eid", F.lit("ev-")), F.substring("_eid", F.lit(4), F.length("_eid")))
    cited = cited.select("aid", "event_id", "sequence", F.explode(F.array_compact(F.array("_eid", bare))).alias("_eid"))
    items = evidence.select(
        "aid", F.col("sequence").alias("_es"), ((F.col("admissibility") == "ADMISSIBLE") & (F.col("grounding") == "SOURCE_CONTENT")).alias("_good"), F.col("event_id").alias("_eid")
    )
    backing = cited.join(items, ["aid", "_eid"]).where("_es <= sequence").groupBy("aid", "event_id").agg(
        F.count("*").alias("resolver_evidence"), F.bool_or("_good").alias("_backed")
    )
    valid = (F.col("resolution") == "MATCHED") & F.coalesce("_backed", F.lit(False)) & F.col("result").isin("CONFIRMED", "REFUTED")
    return (
        v.join(found, ["aid", "event_id"], "left").join(backing, ["aid", "event_id"], "left")
        .withColumn("resolution", F.coalesce("resolution", F.lit("MISSING")))
        .select(
            "aid", "event_id", "sequence", "target_event_id", "claim_id", "resolution", "result",
            F.coalesce("resolver_evidence", F.lit(0)).alias("resolver_evidence"),
            F.when(valid, "VALID").otherwise("INVALID").alias("correctness"),
        )
    )


def conflicts(scoped: DataFrame, matches: DataFrame, checks: DataFrame) -> DataFrame:
    """Conflict per contradiction, with the verification that resolves it, if any.

    One known before the contradiction counts for the first listed target that has one (its latest);
    otherwise the first one after it.
    """
    proof = checks.where("correctness = 'VALID' and target_event_id is not null").select(
        "aid", F.col("target_event_id").alias("event_id"), F.col("event_id").alias("verify_event"), F.col("sequence").alias("_vs"), "result"
    )
    hits = conflict_targets(scoped).join(proof, ["aid", "event_id"])
    before = F.col("_vs") < F.col("conflict_seq")
    # Rank: targets with an earlier proof first, by position, latest proof; then later proofs by time.
    rank = F.struct(F.when(before, 0).otherwise(1).alias("late"), F.when(before, F.col("pos").cast("bigint")).otherwise(F.col("_vs")).alias("k"), F.when(before, -F.col("_vs")).otherwise(F.lit(0)).alias("t"))
    best = hits.groupBy("aid", "conflict_event").agg(F.min_by(F.struct("verify_event", "result"), rank).alias("r"))
    out = matches.withColumnRenamed("event_id", "conflict_event").join(best, ["aid", "conflict_event"], "left")
    start = F.when(F.col("condition_match") == "SAME", "DETECTED").otherwise("POSSIBLE")
    return out.select(
        "aid", "conflict_event", F.concat(F.lit("conflict-"), "conflict_event").alias("conflict_id"), "sequence", "condition_match",
        start.alias("first_status"),
        F.when(F.col("r").isNotNull(), "RESOLVED").otherwise(start).alias("status"),
        F.col("r.verify_event").alias("resolved_by"),
        F.when(F.col("r").isNotNull(), F.when(F.col("r.result") == "REFUTED", "REFUTED").otherwise("CONFIRMED")).alias("resolution"),
        (F.col("r").isNull() & F.col("condition_match").isin("SAME", "AMBIGUOUS", "UNKNOWN")).alias("blocks"),
    )


def conflict_history(found: DataFrame) -> DataFrame:
    """Status changes of each conflict in order."""
    opened = found.select("aid", "conflict_id", F.lit(1).alias("step"), F.col("first_status").alias("status"), F.col("conflict_event").alias("by_event"))
    closed = found.where("status = 'RESOLVED'").select("aid", "conflict_id", F.lit(2).alias("step"), "status", F.col("resolved_by").alias("by_event"))
    return opened.unionByName(closed)


def claim_verdict(claims: DataFrame, support: DataFrame, evidence: DataFrame, found: DataFrame, under: DataFrame) -> DataFrame:
    """Support status per claim; conflicts first, then missing grounds, then opposition."""
    good = grounded(evidence).select("aid", "evidence_id", F.lit(True).alias("_good"))
    counts = support.join(good, ["aid", "evidence_id"], "left").groupBy("aid", "claim_id").agg(
        F.count_if(F.col("role") == "SUPPORT").alias("supporting"),
        F.count_if(F.col("role") == "OPPOSE").alias("opposing"),
        F.count_if((F.col("role") == "SUPPORT") & F.col("_good")).alias("_for"),
        F.count_if((F.col("role") == "OPPOSE") & F.col("_good")).alias("_against"),
    )
    blocked = (
        under.join(found.where("blocks").select("aid", "conflict_event"), ["aid", "conflict_event"])
        .groupBy("aid", "claim_id").agg(F.count("*").alias("blocking_conflicts"))
    )
    out = claims.join(counts, ["aid", "claim_id"], "left").join(blocked, ["aid", "claim_id"], "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("supporting", "opposing", "_for", "_against", "blocking_conflicts")}
    out = out.withColumns(zeros)
    status = (
        F.when(F.col("blocking_conflicts") > 0, "CONFLICTING_EVIDENCE").when(F.col("_for") == 0, "INSUFFICIENT_EVIDENCE")
        .when(F.col("_against") > 0, "CONFLICTING_EVIDENCE").otherwise("STRONGLY_SUPPORTED")
    )
    return out.withColumn("support", status).drop("_for", "_against")


def answer_support(answers: DataFrame, claims: DataFrame, found: DataFrame, under: DataFrame, missing: DataFrame) -> DataFrame:
    """The five rules. ``answers``: aid, completeness. ``claims``: verdicts with importance."""
    core = F.col("importance") == "CORE"
    strong = F.col("support") == "STRONGLY_SUPPORTED"
    tally = claims.groupBy("aid").agg(
        F.count("*").alias("claims"),
        F.count_if(core).alias("core_claims"),
        F.bool_and(F.col("support") == "INSUFFICIENT_EVIDENCE").alias("_none"),
        F.bool_and(F.when(core, strong)).alias("_core_strong"),
        F.bool_and(strong).alias("_all_strong"),
    )
    open_conflicts = found.where("blocks").select("aid", "conflict_event").join(under, ["aid", "conflict_event"])
    on_core = open_conflicts.join(claims.where(core).select("aid", "claim_id").withColumn("_core", F.lit(True)), ["aid", "claim_id"], "left").join(
        tally.select("aid", "core_claims"), "aid", "left"
    )
    blocking = on_core.where(F.col("_core") | (F.coalesce("core_claims", F.lit(0)) == 0)).groupBy("aid").agg(F.count_distinct("conflict_event").alias("open_conflicts"))
    lacking = missing.groupBy("aid").agg(F.count("*").alias("missing_conditions"))
    out = answers.join(tally, "aid", "left").join(blocking, "aid", "left").join(lacking, "aid", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("claims", "core_claims", "open_conflicts", "missing_conditions")})
    complete = F.col("completeness") == "COMPLETE"
    all_core = F.when(F.col("core_claims") > 0, F.col("_core_strong")).otherwise(F.col("_all_strong"))

    def says(status, *codes):
        return F.struct(F.lit(status).alias("status"), F.lit(",".join(codes)).alias("reasons"))

    rule = (
        F.when(F.col("claims") == 0, says("UNKNOWN", "TARGET_UNKNOWN"))
        .when(F.col("open_conflicts") > 0, says("CONFLICTING_EVIDENCE", "UNRESOLVED_CORE_CONFLICT"))
        .when(F.col("_none"), says("INSUFFICIENT_EVIDENCE", "NO_ADMISSIBLE_SUPPORT"))
        .when(~all_core & complete, says("PARTIALLY_SUPPORTED", "PARTIAL_CLAIM_SUPPORT"))
        .when(~all_core, says("PARTIALLY_SUPPORTED", "PARTIAL_CLAIM_SUPPORT", "COLLECTION_NOT_COMPLETE"))
        .when(F.col("missing_conditions") > 0, says("PARTIALLY_SUPPORTED", "MISSING_REQUIRED_CONDITION", "PARTIAL_CLAIM_SUPPORT"))
        .when(complete, says("STRONGLY_SUPPORTED", "ALL_CORE_CLAIMS_SUPPORTED"))
        .otherwise(says("PARTIALLY_SUPPORTED", "COLLECTION_NOT_COMPLETE", "ALL_CORE_CLAIMS_SUPPORTED"))
    )
    return out.withColumn("_rule", rule).select(
        "aid", "completeness", F.col("_rule.status").alias("support"), F.col("_rule.reasons").alias("reason_codes"), "claims", "core_claims", "open_conflicts", "missing_conditions"
    )


def relations(scoped: DataFrame, canonical: DataFrame) -> DataFrame:
    """Declared relations and the CITES relation of each claim that names a source."""
    declared = scoped.select("aid", "event_id", F.inline("relations")).select(
        "aid", F.concat_ws("-", F.lit("rel"), "event_id", "target_event_id", F.lower("type")).alias("relation_id"), "type",
        F.col("event_id").alias("from_id"), F.col("target_event_id").alias("to_id"),
    )
    cites = (
        scoped.where("type = 'CLAIM' and claim.source_id is not null").select("aid", "event_id", F.col("claim.source_id").alias("source_id"))
        .join(canonical, ["aid", "source_id"], "left")
        .withColumn("to_id", F.coalesce("canonical", _src(F.col("source_id"))))
        .select("aid", F.concat(F.lit("rel-claim-"), "event_id", F.lit("-"), "to_id", F.lit("-cites")).alias("relation_id"), F.lit("CITES").alias("type"),
                F.concat(F.lit("claim-"), "event_id").alias("from_id"), "to_id")
    )
    return declared.unionByName(cites)


def reference_diagnostics(scoped: DataFrame) -> DataFrame:
    """CROSS_RUN, DANGLING, LATE_RESOLVED (the target came later) and CYCLE references."""
    rel = scoped.select("aid", "run_id", "event_id", "sequence", F.inline("relations")).drop("type")
    cross = F.col("target_run_id").isNotNull() & (F.col("target_run_id") != F.col("run_id"))
    known = scoped.select("aid", F.col("event_id").alias("target_event_id"), F.col("sequence").alias("target_sequence"))
    local = rel.where(~cross).join(known, ["aid", "target_event_id"], "left")
    kind = F.when(F.col("target_sequence").isNull(), "DANGLING").when(F.col("target_sequence") > F.col("sequence"), "LATE_RESOLVED")
    plain = local.withColumn("kind", kind).where("kind is not null")
    edges = local.where("target_sequence is not null and target_run_id is null").select(
        F.col("aid").alias("run_id"), "event_id", "sequence", "target_event_id", "target_sequence"
    )
    cycles = cycle_edges(edges).select(F.col("run_id").alias("aid"), F.lit("CYCLE").alias("kind"), "event_id", "target_event_id")
    return (
        rel.where(cross).select("aid", F.lit("CROSS_RUN").alias("kind"), "event_id", "target_event_id")
        .unionByName(plain.select("aid", "kind", "event_id", "target_event_id"))
        .unionByName(cycles)
        .withColumn("status", F.when(F.col("kind") == "LATE_RESOLVED", "RESOLVED").otherwise("PENDING"))
    )


def lane_counts(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence by effective provenance; claims add to the lane of their category."""
    lanes = evidence.select("aid", F.col("effective").alias("lane")).unionByName(claims.select("aid", F.col("category").alias("lane")))
    return lanes.groupBy("aid").agg(
        F.count_if(F.col("lane") == "OBSERVED").alias("observed"), F.count_if(F.col("lane") == "REPORTED").alias("reported"),
        F.count_if(F.col("lane") == "INFERRED").alias("inferred"),
        F.count_if(~F.col("lane").isin("OBSERVED", "REPORTED", "INFERRED") | F.col("lane").isNull()).alias("unknown"),
    )


def coverage(support: DataFrame, verdicts: DataFrame, found: DataFrame, under: DataFrame, references: DataFrame) -> DataFrame:
    """Share of claims with any support, and what stays open: conflicts, conditions, distinct reasons, references."""
    claims = verdicts.groupBy("aid").agg(
        F.count_if(F.col("supporting") > 0).alias("covered"),
        F.max((F.col("support") == "INSUFFICIENT_EVIDENCE").cast("int")).alias("_bare"),
        F.max(((F.col("support") == "CONFLICTING_EVIDENCE") & (F.col("blocking_conflicts") == 0)).cast("int")).alias("_opposed"),
    )
    named = (
        under.join(found.where("blocks").select("aid", "conflict_event"), ["aid", "conflict_event"])
        .join(verdicts.select("aid", "claim_id"), ["aid", "claim_id"], "left_semi")
        .groupBy("aid").agg(F.count_distinct("conflict_event").alias("_named"))
    )
    pending = references.where("status = 'PENDING'").groupBy("aid").agg(F.count("*").alias("_pending"))
    out = support.join(claims, "aid", "left").join(named, "aid", "left").join(pending, "aid", "left")
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ("open_conflicts", "missing_conditions", "_bare", "_opposed", "_named", "_pending")]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return out.select("aid", "claims", F.coalesce("covered", F.lit(0)).alias("covered"), total.cast("bigint").alias("unresolved"))


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, value, count = None, "", 0
    out: list[tuple] = []
    for pdf in batches:
        for aid, part, body in zip(pdf["aid"], pdf["part"], pdf["body"], strict=True):
            if (aid, part) != key:
                if key is not None:
                    out.append((*key, value, count))
                key, value, count = (aid, part), "", 0
            value = hashlib.sha256(f"{value}\n{body}".encode()).hexdigest()
            count += 1
        if len(out) > 10_000:
            yield _chain_frame(out)
            out = []
    if key is not None:
        out.append((*key, value, count))
    if out:
        yield _chain_frame(out)


def _chain_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({
        "aid": pd.Series([r[0] for r in rows], dtype=object), "part": pd.Series([r[1] for r in rows], dtype="int64"),
        "value": pd.Series([r[2] for r in rows], dtype=object), "records": pd.Series([r[3] for r in rows], dtype="int64"),
    })


_CHAIN_SCHEMA = T.StructType([
    T.StructField("aid", T.StringType()), T.StructField("part", T.LongType()), T.StructField("value", T.StringType()), T.StructField("records", T.LongType()),
])


def input_revision(bodies: DataFrame) -> DataFrame:
    """Chain hash of each answer's events in order. ``bodies``: aid, sequence, body (canonical text).

    A chain cannot be split, so it runs per slice of 65,536 sequence numbers, in constant memory, and the
    values of the slices are chained in turn, one slice or many.
    """
    def chained(df):
        return df.repartition("aid", "part").sortWithinPartitions("aid", "part", "sequence").mapInPandas(_chain, _CHAIN_SCHEMA)

    parts = stage(chained(bodies.select("aid", sequence_chunk().alias("part"), "sequence", "body")))
    records = parts.groupBy("aid").agg(F.sum("records").alias("records"))
    folded = chained(parts.select("aid", F.lit(0).cast("bigint").alias("part"), F.col("part").alias("sequence"), F.col("value").alias("body")))
    return folded.select("aid", "value").join(records, "aid")
