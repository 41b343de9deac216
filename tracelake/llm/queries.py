"""Registered queries of the numbered operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, jaccard, language, licenses, mixing, near_vectors, packing, pii, repair, tries, url_filter, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the document whose number stands in the path label the page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "/([0-9]+)", 1).try_cast("bigint")
    pages = pages.withColumn("doc_id", number).join(labels, "doc_id", "left")
    return url_filter.judge(pages.select("page_id", "url", "bad"), bad="bad").select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op2_pack_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_matrix(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.spans_of(pii.fit(docs), F.col("text"), spark).alias("found"))
    named = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.transform(F.filter("found", lambda s: s["base"]), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    kinds = F.transform(F.filter("found", lambda s: s["base"]), lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *count, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", named).alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below their source, fifty to a directory; a document of under 400 characters with a notice is named LICENSE."""
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 50).cast("string"))
    short = (F.length("text") < 400) & F.col("text").rlike(licenses.CUE)
    name = F.concat(F.when(short, "LICENSE.").otherwise(""), F.col("doc_id").cast("string"))
    found = licenses.scan(docs.select(F.concat(place, F.lit("/"), name).alias("path"), "text"))
    return found.select(F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint").alias("doc_id"), "path", "license", "score", "basis", "inherited_from")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_pack_large_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    rows = language.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damage(table(spark, sf_dir, "conversations"))))


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_pack_matrix, op3_personal_data, op4_decontaminate, op5_license_scan, op6_warc_archive, op7_pack_large_items, op8_jaccard_join, op9_near_vectors, op10_language_id, op11_conversation_repair, op12_context_mixing, op13_prefix_trie)
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex_sha1, {at}, 5) AS BIGINT) >> {shift}) & 31 AS INT) + 1, 1)"
    for at in range(1, 41, 5)
    for shift in (15, 10, 5, 0)
)

_LABELLED_PAGES = """
    SELECT page_id, url, bad FROM (SELECT page_id, url, try_cast(regexp_extract(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '/([0-9]+)', 1) AS BIGINT) AS doc_id FROM pages)
    LEFT JOIN (SELECT doc_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id) USING (doc_id)"""

_FILES = f"""
    SELECT coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 50) || '/'
           || CASE WHEN length(text) < 400 AND regexp_matches(text, '{licenses.CUE}') THEN 'LICENSE.' ELSE '' END || doc_id AS path, text FROM documents"""

ORACLES: dict[str, str] = {
    "op5_license_scan": f"SELECT CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) AS doc_id, * FROM ({licenses.oracle_sql(_FILES)})",
    "op1_url_filter": url_filter.oracle_sql(_LABELLED_PAGES),
    "op4_decontaminate": decontaminate.oracle_sql(),
    "op13_prefix_trie": tries.oracle_sql(),
    "op6_warc_archive": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex_sha1 FROM pages),
             f AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN f USING (payload)""",
}
