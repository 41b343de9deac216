"""Streaming twins give what the batch operators give."""

import time

from pyspark.sql import functions as F

from tracelake.operators import ingest as I, replay as R
from tracelake.plans import bind
from tracelake.plans.analysis import Analysis
from tracelake.runtime import stage
from tracelake.streaming import live

SF = "/root/testdata/sf0.001"


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def as_stream(spark, frame, tmp_path, parts, key):
    """Write ``frame`` in ``parts`` files by ranges of ``key`` and read them one per batch."""
    path = str(tmp_path / "in")
    lo, hi = frame.agg(F.min(key), F.max(key)).first()
    for i in range(parts):
        part = frame.where((F.col(key) >= lo + (hi + 1 - lo) * i // parts) & (F.col(key) < lo + (hi + 1 - lo) * (i + 1) // parts))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(map(str, df.collect()))


def test_dedup_equals_batch(spark, tmp_path):
    stamped = stage(I.stamp_sequence(bind.records(spark, SF))[0].where("record_kind <> 'run'"))
    _, duplicates, _ = I.dedup_records(stamped)
    out = drain(live.dedup_stream(as_stream(spark, stamped, tmp_path, 3, "line_no")), "dedup", tmp_path)
    got = out.where("verdict <> 'ACCEPTED'").select("run_id", "record_kind", "record_id", F.col("verdict").alias("duplicate_kind"), "first_sequence", F.col("sequence").alias("duplicate_sequence"))
    assert rows(got) == rows(duplicates) and got.count() > 0


def test_verify_first_and_opportunities(spark, tmp_path):
    ev = stage(bind.replay_events(spark, SF))
    out = drain(live.verify_first_stream(as_stream(spark, ev, tmp_path, 3, "seq")), "warn", tmp_path)
    assert rows(out) == rows(R.verify_first(ev))
    data = [("s", 1, "implementation", None, False), ("s", 2, "implementation", None, False), ("s", 3, "implementation", None, False), ("s", 4, "implementation", None, False),
            ("t", 1, "implementation", None, False), ("t", 2, "verification", "test", None), ("t", 3, "implementation", None, True), ("t", 4, "implementation", None, False)]
    small = spark.createDataFrame(data, "session_id string, batch_id bigint, event_type string, verification_kind string, test_only boolean")
    (tmp_path / "two").mkdir()
    got = drain(live.opportunities_stream(as_stream(spark, small, tmp_path / "two", 4, "batch_id")), "opp", tmp_path / "two")
    assert [r.session_id for r in got.collect()] == [r.session_id for r in R.opportunities(small).collect()] == ["s"]


def test_opportunities_go_by_batch_id(spark, tmp_path):
    # two batch ids in one file, and one batch id in two files
    data = [(1, "s", 1, "implementation", None), (1, "s", 2, "implementation", None), (2, "s", 2, "implementation", None), (2, "t", 1, "implementation", None), (3, "s", 3, "implementation", None), (3, "t", 2, "implementation", None)]
    small = spark.createDataFrame([(*r, False) for r in data], "part bigint, session_id string, batch_id bigint, event_type string, verification_kind string, test_only boolean")
    got = drain(live.opportunities_stream(as_stream(spark, small, tmp_path, 3, "part")), "byid", tmp_path)
    assert rows(got) == rows(R.opportunities(small.drop("part")).drop("batch_id")) and [r.session_id for r in got.collect()] == ["s"]


def test_run_progress_equals_batch(spark, tmp_path):
    stamped = stage(I.stamp_sequence(bind.records(spark, SF))[0].where("sequence % 50 <> 49 OR run_id NOT LIKE '%2'"))
    shuffled = stage(stamped.withColumn("part", F.pmod(F.xxhash64("run_id", "sequence"), F.lit(3))))
    out = drain(live.run_progress_stream(as_stream(spark, shuffled, tmp_path, 3, "part")), "progress", tmp_path, "update")
    last = out.groupBy("run_id").agg(F.max_by(F.struct(*out.columns), F.col("applied") + F.col("pending")).alias("r")).select("r.*")
    want = live.run_progress(stamped)
    assert rows(last.select(sorted(last.columns))) == rows(want.select(sorted(want.columns)))
    assert want.where("pending > 0").count() > 0 and want.where("finalized").count() > 0


def test_state_ends(spark, tmp_path):
    path, schema = tmp_path / "in", "run_id string, record_kind string, record_id string, sequence bigint, content_hash string"

    def add(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(str(path))

    def until(done, seconds=60):
        end = time.time() + seconds
        while not done() and time.time() < end:
            time.sleep(0.3)
        return done()

    add(("r", "event", "a", 1, "h"), ("r", "event", "b", 2, "h"))
    stream = live.dedup_stream(spark.readStream.schema(schema).parquet(str(path)), ttl_ms=4_000)
    q = stream.writeStream.outputMode("append").format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def held():
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    def verdicts():
        return {(r.record_id, r.sequence): r.verdict for r in spark.table("ttl").collect()}

    try:
        assert until(lambda: held()[-1:] == [2])
        assert until(lambda: held()[-1:] == [0])  # both ids were last seen too long ago
        add(("r", "event", "a", 4, "other"))
        assert until(lambda: ("a", 4) in verdicts())
        assert verdicts() == {("a", 1): "ACCEPTED", ("b", 2): "ACCEPTED", ("a", 4): "ACCEPTED"}
    finally:
        q.stop()


def test_monitor_and_resets(spark, tmp_path):
    polls = spark.createDataFrame([("r", 1, "RUNNING", 1), ("r", 2, "RUNNING", 1), ("r", 3, "COMPLETED", 2), ("r", 4, "COMPLETED", 2), ("r", 5, "COMPLETED", 2)], "run_id string, poll bigint, lifecycle string, events bigint")
    got = drain(live.monitor(as_stream(spark, polls, tmp_path, 2, "poll")), "mon", tmp_path).orderBy("poll").collect()
    assert [(r.poll, r.stable) for r in got] == [(1, False), (3, False), (5, True)]
    before = spark.createDataFrame([("a", 10, 1), ("b", 10, 1), ("c", 5, 1), ("d", 1, 1)], "path string, length bigint, modified_ms bigint")
    after = spark.createDataFrame([("a", 12, 2), ("b", 4, 2), ("c", 5, 9)], "path string, length bigint, modified_ms bigint")
    assert {(r.path, r.code) for r in live.source_resets(before, after).collect()} == {("b", "SOURCE_TRUNCATED"), ("c", "SOURCE_REPLACED"), ("d", "SOURCE_MISSING")}


def test_incremental_equals_rebuild(spark, tmp_path):
    from tracelake.operators.evidence import scope_events
    from tracelake.streaming import incremental as N

    events = stage(bind.trace_events(spark, SF).where("run_id in ('r1', 'r2', 'r3')"))
    answers, scope = (stage(x) for x in bind.trace_answers(events))
    # answer 0 of each run is told of its shared events at the second batch only
    scope = stage(scope.withColumn("from_batch", F.when((F.col("scope") == "shared") & F.endswith("receipt_id", F.lit("-0")), 1).otherwise(0)))
    root = str(tmp_path / "lake")
    sink = N.IncrementalAnalysis(spark, root, lambda b: answers, lambda b: scope.where(F.col("from_batch") <= b))
    half = events.agg(F.max("sequence")).first()[0] // 2
    for b, rows_of in enumerate((events.where(f"sequence <= {half}"), events.where(f"sequence > {half} AND run_id <> 'r3'"))):
        sink(rows_of, b)
    arrived = events.withColumn("batch", F.when(F.col("sequence") <= half, 0).otherwise(1)).where("batch = 0 OR run_id <> 'r3'")
    plain = arrived.drop("batch")
    # every table equals a rebuild over all input
    full = Analysis(scope_events(plain, answers, scope), answers, scope)
    for name in N.FRAMES:
        want, got = getattr(full, name), sink.current(name)
        assert sorted(want.columns) == sorted(got.columns) and "aid" in want.columns
        assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns))), name
    # the log equals its batch twin, with all three causes
    log = sink.read("invalidations")
    twin = N.invalidation_log(arrived, answers, scope)
    assert rows(log.select("batch", *N.INVALIDATION)) == rows(twin.select("batch", *N.INVALIDATION))
    assert {r.cause for r in log.select("cause").distinct().collect()} == {"NEW_INPUT", "LATE_REFERENCE", "ANSWER_SCOPE_CHANGE"}
    stats = {r.batch: r for r in sink.read("stats").collect()}
    assert stats[1].delta == plain.count() - events.where(f"sequence <= {half}").count() and stats[1].evaluated + stats[1].reused == answers.count()
    assert stats[0].examined == scope_events(events.where(f"sequence <= {half}"), answers, scope.where("from_batch = 0")).count()
    # a batch reads the buckets of its runs only
    plan = sink.events_of(spark.createDataFrame([("r1",)], "run_id string"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan or "PartitionFilters: [isnotnull(bucket#" in plan or "bucket" in plan.split("PartitionFilters")[1][:200]
    sink = N.IncrementalAnalysis(spark, root, lambda b: answers, lambda b: scope.where(F.col("from_batch") <= b), frames=("answer_support",))
    # a repeated batch changes nothing; fresh answers are served as they lie, a stale one is computed again
    before = sink.current().count()
    sink(events.where(f"sequence > {half} AND run_id <> 'r3'"), 1)
    assert sink.current().count() == before and sink.read("bronze").count() == plain.count()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "lake" / "gold").rglob("*.parquet")}
    _, state = sink.serve(1)
    assert {r.status for r in state.collect()} == {"CURRENT"}
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "lake" / "gold").rglob("*.parquet")}
    sink.store(events.where(f"sequence > {half} AND run_id = 'r3'"), 2)
    served, state = sink.serve(2)
    assert {r.aid for r in state.where("status = 'STALE'").collect()} <= {"r3-0", "r3-1", "r3-2"} and state.where("status = 'STALE'").count() > 0
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    want = Analysis(scope_events(events, answers, scope), answers, scope).answer_support
    assert rows(served.select(sorted(served.columns))) == rows(want.select(sorted(want.columns)))


def test_signatures(spark):
    from tracelake.operators.evidence import scope_events

    events = stage(bind.trace_events(spark, SF).where("run_id in ('r1', 'r2')"))
    answers, scope = (stage(x) for x in bind.trace_answers(events))
    stored = live.signatures(scope_events(events.where("sequence < 9"), answers, scope), answers, "1")
    now = live.signatures(scope_events(events, answers, scope), answers, "1")
    assert {r.status for r in live.freshness_of(now, now).collect()} == {"CURRENT"}
    assert "STALE" in {r.status for r in live.freshness_of(stored, now).collect()}
