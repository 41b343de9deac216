"""The corpus pipeline: from ``documents`` to packed sequences in five stages.

Each stage takes what the one before kept, with the columns of ``documents``; the last returns the pieces of all
documents with their places in sequences. Null texts have no language and go at the first stage; repeated rows are one
document from the second stage on; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.llm import decontaminate, jaccard, language, packing, pii
from tracelake.llm.queries import VOCABULARY, table
from tracelake.runtime import stage

#: A document whose language is less likely than this, by the model itself, is rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the others go."""
    model = language.fit(docs)
    judged = language.predict(docs, model)
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 on runs of five words, the document with the least id.

    Documents are told apart by a hash of id and text, so other texts under a repeated id, or under none, are documents of their own; of
    rows that are equal in both one stays. Null ids come after all others.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = stage(jaccard.join_classes(keyed, n=5, num=80, den=100, doc_id="_key").select(F.col("doc_id").alias("_key"), "component_id"))
    linked = groups.where("_key <> component_id").select("component_id").distinct()
    members = groups.join(linked, "component_id", "left_semi").distinct().join(keyed.select("_key", "doc_id"), "_key")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")).alias("first"))
    extra = stage(members.join(first, "component_id").where("_key <> first._key").select("_key").distinct())
    twice = stage(groups.groupBy("_key").count().where("count > 1").select("_key"))
    if extra.count() <= jaccard.BROADCAST_ROWS:
        extra = F.broadcast(extra)
    if twice.count() <= jaccard.BROADCAST_ROWS:
        twice = F.broadcast(twice)
    kept = keyed.join(extra, "_key", "left_anti")
    once = kept.join(twice, "_key", "left_anti").union(kept.join(twice, "_key", "left_semi").dropDuplicates(["_key"]))
    return once.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    redacted = docs.withColumn("text", pii.redacted(pii.fit(docs), F.col("text"), spark))
    return redacted.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets."""
    return packing.pack_pieces(docs, VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack),
]

#: The stages learn models and search by hashes, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
