"""Cases in which results were once incomplete: cycles, offsets, categories, completeness, stage folders, hash forms."""

import hashlib
import json
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracelake import runtime
from tracelake.operators import evidence as E, ingest as I, replay as R, validate as V
from tracelake.sources import lines as L


def test_each_closing_relation_is_listed(spark):
    edges = [("r", "a", 1, "b", 2), ("r", "b", 2, "a", 1), ("r", "c", 3, "d", 5), ("r", "d", 5, "c", 3), ("r", "e", 6, "e", 6), ("r", "f", 7, "g", 8), ("s", "a", 1, "c", 3), ("s", "c", 3, "b", 2), ("s", "b", 2, "a", 1), ("s", "a", 1, "b", 2)]
    df = spark.createDataFrame(edges, "run_id string, event_id string, sequence bigint, target_event_id string, target_sequence bigint")
    got = {(r.run_id, r.event_id, r.target_event_id) for r in I.cycle_edges(df).collect()}
    assert got == {("r", "a", "b"), ("r", "c", "d"), ("r", "e", "e"), ("s", "a", "c"), ("s", "a", "b")}


@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
def test_offsets_count_a_byte_order_mark(spark, tmp_path, mark):
    (tmp_path / "x.jsonl").write_bytes(mark + b'{"a":1}\n{"b":2}\n{"torn":')
    rows = L.read_lines(spark, str(tmp_path))
    assert [r.byte_offset for r in rows.orderBy("line_no").collect()] == [len(mark), len(mark) + 8, len(mark) + 16]
    assert [(r.code, r.definitive) for r in L.scan_losses(rows)[1].collect()] == [("TRUNCATED_TAIL", False)]


def test_categories_are_whole_values(spark):
    record = {"recordKind": "event", "schemaVersion": 1, "runId": "r1", "occurredAt": "2024-01-01T00:00:00Z", "adapterId": "a", "adapterVersion": "1", "eventId": "e", "type": "SEARCH", "payload": {"query": "x"}}
    rows = spark.createDataFrame([(c, json.dumps(record | {"provenance": {"category": c}})) for c in ("TRACE_REPORTED", "NONSENSE_REPORTED", "REPORTED")], "c string, raw string")
    bad = {r.c for r in V.validate_records(rows, "TRACE_")[1].where("field = 'provenance.category'").collect()}
    assert bad == {"NONSENSE_REPORTED", "REPORTED"}


def test_completeness_waits_for_the_end_and_the_drain(spark):
    runs = spark.createDataFrame([("open", "RUNNING"), ("done", "COMPLETED"), ("lost", "FAILED"), ("late", "COMPLETED")], "run_id string, lifecycle string")
    found = spark.createDataFrame([("open", "X", "error"), ("lost", "SOURCE_TRUNCATED", "warning")], "run_id string, code string, severity string")
    drained = spark.createDataFrame([("open",), ("done",), ("lost",)], "run_id string")
    got = {r.run_id: r.completeness for r in I.live_completeness(runs, found, drained).collect()}
    assert got == {"open": "UNKNOWN", "done": "COMPLETE", "lost": "PARTIAL", "late": "UNKNOWN"}


def test_loads_are_compared_in_one_row(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    assert I.same_loads(a, a.repartition(3)).first().asDict() == {"records": 3, "same": True}
    assert not I.same_loads(a, a.distinct()).first().same and not I.same_loads(a, a.withColumn("k", F.col("k") + 1)).first().same
    assert I.same_loads(a.limit(0), a.limit(0)).first().same


def test_a_cluster_needs_a_shared_folder():
    empty = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_hashes_have_one_form(spark):
    """The same rule below and above the sizes at which the form once changed."""
    n = 4_200
    rows = spark.range(n).select(F.lit("s").alias("session_id"), F.lit(1).alias("attempt_no"), F.lit("implementation").alias("event_type"), F.concat(F.lit("h"), "id").alias("change_hash"))
    rows = rows.union(rows.limit(3).withColumn("attempt_no", F.lit(2)))
    for r in R.change_sets(rows).collect():
        held = {f"h{i}" for i in range(n)} if r.attempt_no == 1 else {x.change_hash for x in rows.where("attempt_no = 2").collect()}
        lanes = [sum(int(hashlib.sha256(h.encode()).hexdigest()[12 * i : 12 * i + 12], 16) for h in held) for i in range(4)]
        assert r.changed_files == len(held) and r.change_hash == hashlib.sha256("\n".join(["set", *map(str, lanes)]).encode()).hexdigest()[:32]
    m = 70_000
    chain = lambda bodies: __import__("functools").reduce(lambda v, b: hashlib.sha256(f"{v}\n{b}".encode()).hexdigest(), bodies, "")
    bodies = spark.range(m).select(F.lit("long").alias("aid"), F.col("id").alias("sequence"), F.col("id").cast("string").alias("body"))
    bodies = bodies.union(bodies.limit(5).withColumn("aid", F.lit("short")))
    got = {r.aid: (r.value, r.records) for r in E.input_revision(bodies).collect()}
    parts = [chain(map(str, range(a, min(m, a + 65_536)))) for a in range(0, m, 65_536)]
    assert got == {"long": (chain(parts), m), "short": (chain([chain(map(str, range(5)))]), 5)}


def test_queries_run_from_another_folder(tmp_path):
    """The package travels with the job: no worker needs the repository as its working folder."""
    code = (
        f"import sys; sys.path.insert(0, {str(runtime.Path(runtime.__file__).parents[1])!r})\n"
        "import __spark_entry__ as e\nfrom tracelake.runtime import local_session\n"
        "s = local_session(cores='2')\nprint('ROWS', e.queries()['evd_input_revision'](s, '/root/testdata/sf0.001').count())"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout and "ROWS 0" not in out.stdout, out.stderr[-2000:]


def test_a_changed_scope_of_equal_size_is_stale(spark):
    from tracelake.streaming import live

    answers = spark.createDataFrame([("a", "COMPLETE"), ("b", "COMPLETE"), ("none", "PARTIAL")], "receipt_id string, completeness string")
    old = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 1)], "aid string, event_id string, sequence bigint")
    new = spark.createDataFrame([("a", "z", 2), ("a", "y", 3), ("b", "x", 1)], "aid string, event_id string, sequence bigint")
    got = {r.aid: (r.status, r.reasons) for r in live.freshness_of(live.signatures(old, answers, "1"), live.signatures(new, answers, "1")).collect()}
    assert got == {"a": ("STALE", "SCOPE"), "b": ("CURRENT", ""), "none": ("CURRENT", "")}


def test_an_official_role_is_a_claim_too(spark):
    rows = [("https://10.0.0.1/x", "Notes", ["OFFICIAL"]), ("https://10.0.0.1/x", None, ["PRIMARY"]), ("https://10.0.0.1/x", "Notes", None), ("https://docs.example.org/x", "Official", ["OFFICIAL"]), ("https://spoof.example.org/", "Official", None)]
    got = [r.spoof for r in E.flag_spoof(spark.createDataFrame(rows, "normalized string, title string, roles array<string>")).collect()]
    assert got == [True, True, False, False, True]
