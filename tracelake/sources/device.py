"""Device captures and attempt series as attempt evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Packages whose frames do not belong to the app.
FRAMEWORK = r"^(android\.|java\.|com\.android\.|kotlin\.|androidx\.|dalvik\.)"


def screen_signature(snapshot: Column) -> Column:
    """Page name and eight hex digits over the sorted nodes, with flags removed."""
    lines = F.split(snapshot, r"\r?\n")
    page = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^Page:\s*(.+)$", 1)), lambda x: x != ""), 0)
    window = F.element_at(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r'^#\s+window\s+"([^"]+)"', 1)), lambda x: x != ""), 1)
    name = F.trim(F.coalesce(page, F.when(F.size(F.filter(lines, lambda x: x.rlike(r'^#\s+window\s+"'))) > 0, window)))
    node = r"^@e\d+(?:~s\d+)?\s+\[([^\]]+)\]\s*(.*)$"
    nodes = F.transform(
        F.filter(lines, lambda x: x.rlike(node)),
        lambda x: F.concat(F.lit("["), F.regexp_extract(x, node, 1), F.lit("] "), F.trim(F.regexp_replace(F.regexp_extract(x, node, 2), r"(?:\s+\[[a-z-]+\])+$", ""))),
    )
    digest = F.substring(F.sha2(F.array_join(F.array_sort(nodes), "\n"), 256), 1, 8)
    return F.when(F.size(nodes) > 0, F.concat(F.coalesce(name, F.lit("screen")), F.lit("#"), digest)).otherwise(name)


def crash_signature(logs: Column) -> Column:
    """Simple exception name with the first frame of the app below it; null without an exception."""
    lines = F.split(logs, r"\r?\n")
    pattern = r"([\w.$]*(?:Exception|Error))\s*:"
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True)
    name = F.element_at(F.split(F.regexp_extract(F.get(lines, (at - 1).cast("int")), pattern, 1), r"\."), -1)
    frame = r"(?:^|\s)at\s+([\w.$]+)\.([\w$<>]+)\("
    below = F.filter(lines, lambda x, i: (i >= at) & x.rlike(frame) & ~F.regexp_extract(x, frame, 1).rlike(FRAMEWORK))
    first = F.get(below, 0)
    where = F.concat(F.element_at(F.split(F.regexp_extract(first, frame, 1), r"\."), -1), F.lit("#"), F.regexp_extract(first, frame, 2))
    return F.when(at > 0, F.concat_ws(":", name, where))


def capture_evidence(captures: DataFrame) -> DataFrame:
    """``captures``: attempt_id, snapshot_text, logs_text (null when not taken)."""
    return captures.select(
        "attempt_id", screen_signature(F.col("snapshot_text")).alias("screen_sig"), crash_signature(F.col("logs_text")).alias("crash_sig"), F.col("snapshot_text").isNotNull().alias("verified")
    )


def attempt_series(spark: SparkSession, path: str) -> DataFrame:
    """Series files (a JSON array of attempts each, or an object with ``attempts``) as attempt evidence."""
    attempt = (
        "struct<attemptId:string,build:struct<status:string>,tests:struct<failedCount:int>,runtime:struct<crashSignature:string,screenSignature:string>,"
        "verification:struct<performed:boolean>,code:struct<changedFilesCount:int,changeSetHash:string>>"
    )
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("series_id"), "value")
    body = F.coalesce(F.get_json_object("value", "$.attempts"), F.col("value"))
    return files.select("series_id", F.posexplode(F.from_json(body, f"array<{attempt}>")).alias("idx", "a")).select(
        "series_id", F.col("idx").cast("bigint").alias("idx"), F.col("a.attemptId").alias("attempt_id"), F.col("a.build.status").alias("build_status"), F.col("a.tests.failedCount").alias("tests_failed"),
        F.col("a.runtime.crashSignature").alias("crash_sig"), F.col("a.runtime.screenSignature").alias("screen_sig"), F.col("a.verification.performed").alias("verified"),
        F.col("a.code.changedFilesCount").alias("changed_files"), F.col("a.code.changeSetHash").alias("change_hash"),
    )
