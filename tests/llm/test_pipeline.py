"""The pipeline stage by stage, and the registered queries with SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.check_oracles import compare, oracle
from tracelake.llm import decontaminate, pii

from .test_near_operators import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(9_000_001, "12345 !!!", None, "s", 9), (9_000_002, None, "en", "s", None)], docs.schema)
    now, seen = docs.union(junk).union(docs.where("doc_id < 5")), []
    for name, step in corpus_pipeline.STAGES:
        before = now
        now = step(spark, now, SF)
        seen.append(name)
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
        ids, old = {r.doc_id for r in now.collect()}, {r.doc_id: r.text for r in before.collect()}
        if name == "language_id":
            assert old.keys() - ids == {9_000_001, 9_000_002}
        elif name == "ngram_jaccard_join":
            assert ids == {i for i, (_, c) in brute(list(old.items()), 5, 80, 100).items() if i == c} and now.count() == len(ids)
        elif name == "decontamination":
            dirty = {r.doc_id for r in decontaminate.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert dirty and ids == old.keys() - dirty
        elif name == "personal_data":
            assert ids == old.keys() and not any(pii.base_spans(r.text) for r in now.collect())
            assert all(r.text == old[r.doc_id] for r in now.collect() if not pii.candidates(old[r.doc_id]))
        else:
            assert ids == old.keys()
    assert len(seen) == 5


def test_near_copies_under_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(7, a), (1, a), (7, b), (7, b), (None, a), (None, c), (None, c + " more"), (3, None), (4, None), (5, ""), (8, b + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=repr)
    last = next(t for i, t in kept if i is None)
    assert last in (c, c + " more")
    assert kept == sorted([(1, a), (7, b), (None, last), (3, None), (4, None), (5, "")], key=repr)
    empty = corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == docs.columns


@pytest.mark.parametrize("name", ["op1_url_filter", "op4_decontaminate", "op5_license_scan", "op6_warc_archive", "op13_prefix_trie"])
def test_sql_twins(spark, name):
    assert compare(spark, oracle(SF), name, SF).startswith("ok")


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert duckdb.sql("SELECT 1").fetchall() == [(1,)]
