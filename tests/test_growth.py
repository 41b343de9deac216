"""Steps that must grow no faster than their input: how they are spread, what they write, how often they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import validate as V


def test_records_of_one_file_are_validated_on_all_cores_and_rules_run_once(spark, monkeypatch):
    """One small file used to be validated in one task, with four probes for each path, and its rules were run again for each output."""
    written = []
    keep = V.stage
    monkeypatch.setattr(V, "stage", lambda df: written.append((df.rdd.getNumPartitions(), df.columns)) or keep(df))
    body = '{"recordKind":"run","schemaVersion":1,"runId":"r1","occurredAt":"2026-02-03T00:00:00Z","adapterId":"a","adapterVersion":"1","lifecycle":"RUNNING"}'
    lines = spark.range(40).coalesce(1).select("id", F.when(F.col("id") % 4 == 0, "[]").otherwise(body).alias("raw"))
    valid, notes = V.validate_records(lines, "TRACE_")
    assert valid.count() == 30 and {r.code for r in notes.collect()} == {"INVALID_RECORD"} and notes.count() == 10
    assert len(written) == 2 and all(parts >= min(8, spark.sparkContext.defaultParallelism) for parts, _ in written[:1])
    paths = [c for c in written[0][1] if c.startswith("_f")]
    assert len(paths) < 200 and sum(c.endswith("v") for c in paths) < 30
    assert written[1][1] == ["id", "v", "body", "_e", "_w", "_i"]


def test_rejected_options_broadcast_no_rows_of_runs(spark):
    """The runs of all claims used to be joined by a broadcast, with the texts on every row: the driver held them all."""
    from tracelake.operators import lens as L

    scoped = spark.sql("""SELECT 'a' AS aid, 'v9' AS event_id, 9L AS sequence, 'RECOMMEND' AS type,
        named_struct('choice', 'alpha', 'alternatives', array('Beta', 'g', '', 'other')) AS recommend""")
    verdicts = spark.sql("""SELECT * FROM VALUES ('a', 'claim-v1', 'about beta', 1L), ('a', 'claim-v2-other-cost', 'none', 1L), ('a', 'claim-v3', 'beta too', 0L), ('b', 'claim-v1', 'beta', 1L)
        AS t(aid, claim_id, text, supporting)""")
    out = L.decide(scoped, verdicts)[1]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in plan and "BroadcastHashJoin" not in plan
    found = {(r.option, r.claim_id) for r in out.collect()}
    assert found == {("Beta", "claim-v1"), ("g", None), ("", None), ("other", "claim-v2-other-cost")}


def test_invalidations_broadcast_no_events(spark):
    """Joins used to be broadcast by the packed size of files, with a row for each event of each answer."""
    from tracelake.plans import catalog_streams

    plan = catalog_streams.invalidations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin [" in line or "SortMergeJoin [" in line]
    assert any("SortMergeJoin" in line for line in joins) and not any("BroadcastHashJoin" in line and "event_id" in line for line in joins)


def _events(spark):
    return spark.sql("""SELECT 'a' AS aid, 'r' AS run_id, concat('v', id) AS event_id, id AS sequence, if(id % 3 = 0, 'SEARCH', 'READ') AS type, 'OBSERVED' AS category, true AS has_locator,
        named_struct('source_id', concat('s', id % 4), 'kind', 'URL', 'location', concat('https://h', id % 2, '.org/'), 'content_hash', '', 'title', if(id % 4 = 1, 'T', ''), 'accessed_at', '') AS source,
        if(id % 3 = 0, named_struct('query', 'q', 'results', array(named_struct('source_id', 's9', 'title', '', 'url', 'https://h0.org', 'rank', 1), named_struct('source_id', 's8', 'title', '', 'url', 'https://h0.org/', 'rank', 2))), null) AS search,
        named_struct('source_id', concat('s', id % 4), 'outcome', 'SUCCESS') AS read FROM range(1, 13)""")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_ledger_counts_without_copies_of_its_rows(spark):
    """Two distinct counts used to multiply the mentions by three and to shuffle them twice."""
    from tracelake.operators import evidence as E

    refs = E.source_refs(_events(spark))
    assert "Filter" not in _plan(refs).split("Generate")[1]  # a guard there worked out all addresses again
    ledger = E.source_ledger(E.source_captures(refs))
    assert "Expand" not in _plan(ledger)
    got = {r.key: (r.first.sequence, r.source, r.title, r.anchors, r.captured_ids, r.queries) for r in ledger.collect()}
    assert got == {"loc:https://h1.org/": (1, "src-s1", "T", 6, 2, 2), "loc:https://h0.org/": (2, "src-s2", None, 14, 4, 4)}


def test_scans_within_one_chunk_carry_nothing_over(spark):
    """Each scan used to be joined with a summary for each key, though no key reached into a second chunk."""
    from tracelake.operators import evidence as E
    from tracelake.operators.ordered import one_chunk, ordered_scan, last_seen, next_seen, running_min, running_sum, sequence_chunk

    rows = spark.range(1, 200).select(F.concat(F.lit("k"), F.col("id") % 5).alias("key"), F.col("id").alias("sequence"))
    assert one_chunk(rows) and not one_chunk(rows.withColumn("sequence", F.col("sequence") * 1000))
    v = F.col("sequence") % 7
    scans = {"a": running_sum(v), "b": running_min(v), "c": last_seen(v, v > 3), "d": next_seen(v, v > 3)}
    short, long = (ordered_scan(rows, ["key"], ["sequence"], sequence_chunk(), whole, **scans) for whole in (True, False))
    assert "Join" not in _plan(short) and "Join" in _plan(long)
    assert sorted(short.collect()) == sorted(long.collect())
    events = _events(spark)
    captures = E.source_captures(E.source_refs(events))
    sources = E.flag_spoof(E.source_ledger(captures))
    both = [sorted(E.adjudicate(events, captures, sources, whole).collect()) for whole in (True, False)]
    assert both[0] == both[1] and [r.source for r in sorted(both[0], key=lambda r: r.sequence)][:4] == ["src-s1", "src-s2", "src-s1", "src-s2"]


def test_scans_over_a_named_chunk_move_the_rows_once(spark):
    """Each of the three scans of hook packets used to shuffle the packets with all they hold."""
    from tracelake.operators.ordered import last_seen, ordered_scan, running_sum

    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id") % 3).alias("key"), F.col("id").alias("line_no"), F.lit("text").alias("payload"), F.floor(F.col("id") / 20).alias("slice"))

    def scans(chunk):
        one = ordered_scan(rows, ["key"], ["line_no"], chunk, a=running_sum(F.col("line_no")))
        return ordered_scan(one, ["key"], ["line_no"], chunk, b=last_seen(F.col("a"), F.col("a") % 2 == 0))

    moved = {}
    for name, chunk in (("named", "slice"), ("worked out", F.col("slice") + 0)):
        moved[name] = scans(chunk)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key")
    assert moved["named"] < moved["worked out"]
    assert sorted(scans("slice").collect()) == sorted(scans(F.col("slice") + 0).collect())


def test_light_queries_build_no_verdicts(spark, monkeypatch):
    """The choice of an answer, its lanes and its sequence used to build the whole analysis or all columns of the scoped events first."""
    from tracelake.plans import catalog_evidence as C
    from tracelake.operators import evidence as E

    kept = []
    keep = C.silver
    monkeypatch.setattr(C, "silver", lambda s, d, name, build: kept.append(name) or keep(s, d, name, build))
    d = "/root/testdata/sf0.001"
    needs = {"prj_decide": set(), "evd_lane_counts": set(), "top_sequence_edges": {"evd_branched"}, "top_facet_nodes": {"evd_refs", "evd_captures", "evd_sources"}}
    for name, wanted in needs.items():
        kept.clear()
        C.QUERIES[name](spark, d)
        assert set(kept) - {"trace_events"} == wanted, name
    kept.clear()
    C.QUERIES["prj_overview"](spark, d)
    assert not {"evd_checks", "evd_verdicts", "evd_support_rows", "evd_answer_support"} & set(kept)

    a = C.analysis(spark, d)
    assert sorted(E.provenance(a.lean).collect()) == sorted(a.evidence.select("aid", "effective").collect())
    assert sorted(a.conflicts.collect(), key=str) == sorted(E.conflicts(a.scoped, a.matches, a.checks).collect(), key=str)


def test_lifecycle_and_agents_are_built_once(spark, monkeypatch):
    """Problems, outcome and root each built the graph of agents, and two of them the liveness of all sessions."""
    from tracelake.operators import sessions as S
    from tracelake.plans import catalog_sessions as C, silver

    calls = []
    monkeypatch.setattr(silver, "_BUILT", {})
    for name in ("agent_graph", "liveness"):
        real = getattr(S, name)
        monkeypatch.setattr(S, name, lambda *a, real=real, name=name: calls.append(name) or real(*a))
    C.QUERIES["ses_root_agent"](spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["agent_graph", "liveness"]


def test_attempts_within_one_chunk_move_the_rows_once(spark):
    """Each of the two scans used to shuffle the events and to join them with a summary of their chunks."""
    from tracelake.operators import replay as R

    rows = spark.range(1, 60).select(F.concat(F.lit("s"), F.col("id") % 3).alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") % 5 < 2, "verification").when(F.col("id") % 7 == 0, "other").otherwise("implementation").alias("event_type"))
    short, long = R.segment(rows, True), R.segment(rows)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(session_id") == 1 and "Join" not in plan
    assert sorted(short.collect()) == sorted(long.collect())


def test_rollout_lines_are_written_on_all_cores(spark):
    """The lines of a small file of events were written and parsed in as many tasks as the file has parts."""
    from tracelake.plans import catalog_rollout as C

    assert "RoundRobinPartitioning" in C.rollout_log(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_rules_are_compiled_and_fields_are_probed_for_their_kind_only(spark, monkeypatch):
    """All rules used to be interpreted, under a filter by a lambda, and each record was searched for the fields of all kinds by its JSON text."""
    frames = []
    keep = V.stage
    monkeypatch.setattr(V, "stage", lambda df: frames.append(df) or keep(df))
    run = '{"recordKind":"run","schemaVersion":1,"runId":"r1","occurredAt":"2026-02-03T00:00:00Z","adapterId":"a","adapterVersion":"1","lifecycle":"RUNNING","payload":{"text":""},"source":3}'
    lines = spark.createDataFrame([(0, run), (1, run.replace("RUNNING", "LOST")), (2, run.replace('"run"', '"event"')), (3, run.replace('"run"', "7")), (4, "3")], "id int, raw string")
    valid, notes = V.validate_records(lines, "TRACE_")
    assert [r.id for r in valid.collect()] == [0]
    found = {(r.id, r.code, r.field) for r in notes.collect()}
    assert {f for f in found if f[0] in (0, 1, 3, 4)} == {
        (0, "UNKNOWN_FIELD_DROPPED", None), (1, "UNKNOWN_FIELD_DROPPED", None), (1, "INVALID_FIELD", "lifecycle"), (3, "INVALID_FIELD", "recordKind"), (4, "INVALID_RECORD", "record")}
    assert {(2, "INVALID_FIELD", "source"), (2, "MISSING_FIELD", "eventId"), (2, "INVALID_FIELD", "type")} <= found and (2, "INVALID_FIELD", "lifecycle") not in found
    probes, rules = (f._jdf.queryExecution().optimizedPlan().toString() for f in frames[:2])
    assert "to_json" not in probes and "filter(array(" not in rules
    place = next(f for f in frames[0].columns if f.startswith("_f"))
    rows = {r.id: r for r in frames[0].select("id", *[c for c in frames[0].columns if c.startswith("_f") and c.endswith("k")]).collect()}
    assert place and sum(x is not None for x in rows[0]) < sum(x is not None for x in rows[2])


def test_lines_are_written_once_before_their_scan(spark, monkeypatch):
    """Records and losses each used to build and parse all lines, in as many tasks as the source has splits."""
    from tracelake.plans import catalog_intake, intake

    scanned = []
    keep = intake.scan_losses
    monkeypatch.setattr(intake, "scan_losses", lambda lines: scanned.append(lines) or keep(lines))
    lines = catalog_intake.trace_lines(spark, "/root/testdata/sf0.001")
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    intake.ingest_lines(lines, "TRACE_")
    plan = scanned[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Relation") and scanned[0].count() == lines.count()
