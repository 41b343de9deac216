"""Line sources: discovery, numbered lines, tolerant and loss-honest JSONL scans, format detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import ordered_scan, running_sum
from ..operators.validate import parse_strict

MAX_LINE_BYTES = 4 * 1024 * 1024


def discover(spark: SparkSession, roots: list[str]) -> DataFrame:
    """JSONL files below the roots with time and size; empty files are skipped. A caller that wants a page orders it."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(roots)
        .select("path", F.unix_millis("modificationTime").alias("modified_ms"), F.col("length").alias("size_bytes"))
        .where("size_bytes > 0")
    )


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row per line: file, line_no, byte_offset, byte_length, raw, and whether a newline ended it.

    Large files are split. Within a split lines come in order, so (split start, row id) orders a file
    and numbering is an ordered scan with the split as its chunk; no file is read by one task.
    """
    rows = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("file_size"),
            F.monotonically_increasing_id().alias("_row"), F.col("value").alias("raw"),
        )
    )
    size = F.octet_length("raw").cast("bigint")
    numbered = ordered_scan(
        rows.withColumn("byte_length", size), ["file"], ["_block", "_row"], F.col("_block"),
        line_no=running_sum(F.lit(1)), byte_offset=running_sum(F.col("byte_length") + 1, inclusive=False),
    )
    # The reader drops a byte order mark: then the lines are three bytes short of the file.
    whole = numbered.groupBy("file").agg(F.max(F.col("byte_offset") + F.col("byte_length") + 1).alias("_whole"))
    mark = F.when(F.col("file_size") - F.col("_whole") >= 2, 3).otherwise(0)
    numbered = numbered.join(whole, "file").withColumn("byte_offset", F.col("byte_offset") + mark)
    ended = F.col("byte_offset") + F.col("byte_length") < F.col("file_size")
    return numbered.select("file", "line_no", "byte_offset", "byte_length", "raw", ended.alias("ended"))


def scan_tolerant(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed lines, and a warning per line that is not JSON. The session survives bad lines."""
    body = F.regexp_replace("raw", r"^\s+|\s+$", "")
    rows = lines.withColumn("raw", body).where("raw <> ''").withColumn("v", parse_strict(F.col("raw")))
    bad = rows.where("v is null").select(
        "file", "line_no", F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": invalid JSON skipped")).alias("warning")
    )
    return rows.where("v is not null"), bad


def scan_losses(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readable lines, losses with their place but never their content, and blank lines.

    A bad last line without its newline is a TRUNCATED_TAIL and not definitive: more may come.
    """
    content = F.regexp_replace("raw", r"\r$", "")
    utf8 = F.is_valid_utf8("raw")
    rows = lines.withColumn("_c", content).withColumn("_utf8", utf8)
    rows = rows.withColumn("v", F.when((F.col("byte_length") <= max_bytes) & F.col("_utf8"), parse_strict(F.col("_c"))))
    blank = F.col("_utf8") & (F.trim("_c") == "")
    code = (
        F.when(F.col("byte_length") > max_bytes, "OVERSIZED_LINE")
        .when(blank, None)
        .when(F.col("v").isNotNull(), None)
        .when(~F.col("ended"), "TRUNCATED_TAIL")
        .when(~F.col("_utf8"), "INVALID_UTF8")
        .otherwise("MALFORMED_JSON")
    )
    marked = rows.withColumn("code", code).withColumn("_blank", blank & (F.col("byte_length") <= max_bytes))
    losses = marked.where("code is not null").select(
        "file", "line_no", "byte_offset", F.octet_length("_c").cast("bigint").alias("byte_length"), "code", F.col("ended").alias("definitive")
    )
    return marked.where("v is not null").select("file", "line_no", "byte_offset", "raw", "v"), losses, marked.where("_blank").select("file", "line_no")


def detect_adapter(lines: DataFrame) -> DataFrame:
    """Format of each file from its first lines: codex, zcode, claude, generic-jsonl, or null."""
    rows = lines.where(F.trim("raw") != "")
    # The first ten non-blank lines lie within the first lines of the file unless blanks come first.
    nth = ordered_scan(rows, ["file"], ["line_no"], F.floor(F.col("line_no") / 65_536), nth=running_sum(F.lit(1))).where("nth <= 10")
    fields = "type string, sessionId string, parentUuid string, ordinal string, timestamp string, id string, response struct<text:string,toolCalls:string>"
    j = F.from_json("raw", fields)
    head = nth.withColumn("j", j)
    five = F.col("nth") <= 5
    has = {n: F.bool_or(F.contains("raw", F.lit(t))) for n, t in {
        "item": '"type":"response_item"', "meta": '"type":"session_meta"', "calls": '"toolCalls"', "parent": '"parentUuid"', "snap": '"file-history-snapshot"',
        "sid": '"sessionId"', "ts": '"timestamp"'}.items()}
    codex = F.bool_or(five & F.coalesce((F.col("j.type") == "session_meta") | ((F.col("j.type") == "response_item") & F.col("j.ordinal").isNotNull()), F.lit(False)))
    zcode = F.bool_or(five & F.col("j.sessionId").isNotNull() & (F.col("j.response.toolCalls").isNotNull() | F.col("j.response.text").isNotNull()))
    claude = F.bool_or(five & F.col("j.type").isin("user", "assistant", "file-history-snapshot") & (F.col("j.sessionId").isNotNull() | F.contains("raw", F.lit('"parentUuid"'))))
    hits = F.count_if(F.col("j.type").isNotNull() & F.col("j.sessionId").isNotNull() & F.col("j.timestamp").isNotNull() & F.col("j.id").isNotNull())
    g = head.groupBy("file").agg(
        *[c.alias(f"_{n}") for n, c in has.items()], F.coalesce(codex, F.lit(False)).alias("codex"), F.coalesce(zcode, F.lit(False)).alias("zcode"),
        F.coalesce(claude, F.lit(False)).alias("claude"), (hits >= F.greatest(F.lit(1), F.ceil(F.count("*") / 2))).alias("generic"),
    )
    return g.select(
        "file",
        F.when((F.col("_item") | F.col("_meta")) & F.col("codex"), "codex")
        .when(F.col("_calls") & F.col("zcode"), "zcode")
        .when((F.col("_parent") | F.col("_snap")) & F.col("claude"), "claude")
        .when(F.col("_sid") & F.col("_ts") & F.col("generic"), "generic-jsonl")
        .when(F.col("codex"), "codex").when(F.col("zcode"), "zcode").when(F.col("claude"), "claude").when(F.col("generic"), "generic-jsonl")
        .alias("adapter"),
    )
