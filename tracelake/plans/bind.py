"""Read the given tables and see them as the engine's inputs.

The tables know nothing of agents, so event types stand for session events: an error is a failing
step, a purchase a passing one, a click a change, a view a read, a signup everything else; the number
``k`` in ``props`` spreads rows over the vocabulary. ``SESSION_EVENTS_SQL`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SESSION_COLUMNS = """
  concat('e', event_id) AS id,
  concat('u', user_id) AS session_id,
  CASE WHEN k % 6 = 0 THEN concat('e', event_id - 1) END AS parent_id,
  CASE WHEN type IN ('SUBAGENT_STARTED', 'SUBAGENT_COMPLETED') THEN concat('a', 1 + k % 3)
       WHEN event_id % 16 = 7 THEN 'a4' WHEN event_id % 4 = 2 THEN 'a1' WHEN event_id % 4 = 3 THEN 'a2'
       ELSE 'main' END AS agent_id,
  CASE WHEN type = 'SUBAGENT_STARTED' AND k % 20 <> 0 THEN concat('a', 1 + tens % 3) END AS parent_agent_id,
  type,
  ts_ms,
  event_id AS input_index,
  CAST(NULL AS double) AS duration_ms,
  'events' AS source,
  CASE WHEN type = 'MESSAGE' THEN concat(CASE WHEN k = 42 THEN '/model ' ELSE 'message ' END, k) END AS summary,
  CASE WHEN type = 'MESSAGE' THEN CASE WHEN k % 20 = 2 THEN 'user' ELSE 'assistant' END END AS meta_role,
  CASE WHEN type = 'SUBAGENT_STARTED' THEN concat('task', tens % 4) END AS meta_task,
  CASE WHEN type = 'SESSION_STARTED' THEN concat('/home/dev/proj', k) END AS meta_cwd,
  CASE WHEN type = 'SESSION_COMPLETED' THEN CASE WHEN event_id % 3 = 0 THEN 'success' WHEN event_id % 3 = 2 THEN 'failure' END END AS meta_outcome,
  CAST(NULL AS {string}) AS meta_status,
  CASE WHEN type = 'TEST_FAILED' AND k % 3 <> 0 THEN CAST(floor(value) % 10 AS double) END AS meta_tests_failed,
  CASE WHEN type IN ('FILE_CHANGED', 'FILE_CREATED') THEN CAST(floor(value) AS double) END AS meta_additions,
  CASE WHEN type IN ('FILE_CHANGED', 'FILE_CREATED') AND k % 2 = 0 THEN CAST(k AS double) END AS meta_deletions,
  CASE WHEN type LIKE 'FILE_%' OR (type = 'ERROR' AND k % 4 = 0) THEN concat('src/f', k % 20, '.ts') END AS file_path,
  CASE WHEN type LIKE 'COMMAND_%' AND k % 13 <> 0 THEN concat('npm run task', k % 3)
       WHEN type LIKE 'TEST_%' AND k % 2 = 0 THEN 'npm test' END AS command,
  CASE WHEN type = 'TOOL_RESULT' THEN 'edit' END AS tool_name,
  CASE WHEN type = 'TOOL_RESULT' THEN 'error'
       WHEN type = 'SUBAGENT_COMPLETED' THEN CASE WHEN k % 3 = 0 THEN 'error' WHEN k % 3 = 1 THEN 'ok' END
       WHEN type = 'COMMAND_COMPLETED' AND event_type = 'error' THEN CASE WHEN k % 4 = 0 THEN 'timeout' WHEN k % 8 = 2 THEN 'aborted' ELSE 'error' END
       WHEN type = 'COMMAND_COMPLETED' THEN 'ok' END AS status,
  CASE WHEN type = 'TOOL_RESULT' THEN concat('edit failed', chr(10), 'second line')
       WHEN type = 'SUBAGENT_COMPLETED' AND k % 2 = 1 THEN 'quota exceeded for this key'
       WHEN type = 'ERROR' THEN CASE k % 5 WHEN 0 THEN 'HTTP 429 too many requests' WHEN 1 THEN 'connect ECONNRESET'
            WHEN 2 THEN 'TypeError: x is undefined' WHEN 4 THEN 'API Error: 500' END END AS error,
  CASE WHEN type = 'COMMAND_COMPLETED' AND event_type = 'error' AND k % 4 <> 0 AND k % 8 <> 2 THEN 1
       WHEN type = 'COMMAND_COMPLETED' AND event_type <> 'error' THEN 0 END AS exit_code
"""
_TYPE = """
CASE event_type
  WHEN 'error' THEN CASE k % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'BUILD_FAILED' WHEN 2 THEN 'COMMAND_COMPLETED' WHEN 4 THEN 'TOOL_RESULT' ELSE 'TEST_FAILED' END
  WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 'BUILD_PASSED' WHEN 1 THEN 'COMMAND_COMPLETED' ELSE 'TEST_PASSED' END
  WHEN 'click' THEN CASE WHEN k % 7 = 0 THEN 'FILE_CREATED' WHEN k % 11 = 0 THEN 'FILE_DELETED' ELSE 'FILE_CHANGED' END
  WHEN 'view' THEN 'FILE_READ'
  ELSE CASE WHEN k % 10 = 0 THEN 'SUBAGENT_STARTED' WHEN k % 10 = 1 THEN 'SUBAGENT_COMPLETED' WHEN k % 10 = 2 THEN 'MESSAGE'
            WHEN k = 93 THEN 'SESSION_COMPLETED' WHEN k IN (3, 13) THEN 'SESSION_STARTED' WHEN k % 10 = 3 THEN 'TEST_STARTED'
            WHEN k % 10 = 4 THEN 'BUILD_STARTED' ELSE 'COMMAND_STARTED' END
END
"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "*",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [c for c in _SESSION_COLUMNS.format(string="string").split(",\n")]
    return (
        raw_events(spark, sf_dir)
        .withColumn("tens", F.floor(F.col("k") / 10).cast("int"))
        .withColumn("type", F.expr(_TYPE))
        .selectExpr(*cols)
    )


SESSION_EVENTS_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
ev2 AS (SELECT *, k // 10 AS tens, {_TYPE} AS type FROM ev),
se AS (SELECT {_SESSION_COLUMNS.format(string='varchar')} FROM ev2)"""


_REPLAY_COLUMNS = """
  concat('u', user_id) AS session_id,
  CASE WHEN user_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS source,
  event_id AS seq,
  CASE event_type WHEN 'click' THEN 'implementation' WHEN 'view' THEN 'observation' WHEN 'signup' THEN 'other' ELSE 'verification' END AS event_type,
  ts_ms - start_ms AS ts_offset,
  CASE event_type WHEN 'click' THEN CASE WHEN k % 5 = 0 THEN 'Write' ELSE 'Edit' END WHEN 'view' THEN 'Read' WHEN 'signup' THEN 'Task' ELSE 'Bash' END AS tool_name,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 17 > 0 THEN TRUE END WHEN event_type = 'error' THEN CASE WHEN k % 17 > 0 THEN FALSE END END AS ok,
  CASE WHEN event_type IN ('purchase', 'error') THEN CASE k % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'build' ELSE 'device' END END AS verification_kind,
  CASE WHEN event_type = 'click' THEN 1 END AS changed_files,
  CASE WHEN event_type = 'click' AND k % 10 < 9 THEN substr({sha}, 1, 32) END AS change_hash,
  CASE WHEN event_type = 'click' AND k % 10 < 9 THEN CASE WHEN k % 4 = 0 THEN 'path' ELSE 'content' END END AS fingerprint_basis,
  CASE WHEN event_type = 'error' THEN concat('sig', k % 2) END AS failure_sig,
  CASE WHEN event_type = 'error' AND k % 3 = 0 THEN k % 10 WHEN event_type = 'purchase' AND k % 2 = 0 AND k % 3 = 0 THEN 0 END AS tests_failed,
  CAST(value AS double) AS duration_ms,
  CAST(floor(ts_ms / 86400000) AS bigint) AS turn,
  CASE WHEN event_type = 'click' THEN k % 9 = 0 END AS test_only,
  CASE WHEN event_type IN ('click', 'view') THEN concat('src/f', k % 20, '.ts') END AS path,
  ts_ms AS last_ms,
  CAST(floor(event_id / 500) AS bigint) AS batch_id
"""


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    start = raw.groupBy("user_id").agg(F.min("ts_ms").alias("start_ms"))
    cols = _REPLAY_COLUMNS.format(sha="sha2(props, 256)").split(",\n")
    return raw.join(start, "user_id").selectExpr(*cols)


REPLAY_EVENTS_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
ev3 AS (SELECT *, min(ts_ms) OVER (PARTITION BY user_id) AS start_ms FROM ev),
re AS (SELECT {_REPLAY_COLUMNS.format(sha='sha256(props)')} FROM ev3)"""


def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running quantity of an order by ship date as a cumulative counter."""
    from ..operators.ordered import ordered_scan, running_sum

    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("session_id"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice").alias("tie"),
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    return ordered_scan(
        lines, ["session_id"], ["ts_ms", "line", "l_partkey", "l_suppkey"], F.floor(F.col("ts_ms") / 86_400_000 / 365), total_tokens=running_sum(F.col("quantity"))
    ).select("session_id", "ts_ms", F.col("total_tokens").alias("record_no"), "total_tokens")


def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("w"), F.col("o_orderkey")).alias("window_id"),
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("session_id"),
        (placed + F.lit(30 * 86_400_000)).alias("from_ms"),
        (placed + F.lit(400 * 86_400_000)).alias("to_ms"),
    )


_EVIDENCE_COLUMNS = """
  concat('s', user_id, '-', tens_day) AS series_id,
  position - 1 AS idx,
  concat('attempt-', event_id) AS attempt_id,
  CASE k % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'unknown' END AS build_status,
  CASE WHEN k % 7 > 0 THEN CAST(floor(value) AS int) % 4 END AS tests_failed,
  CASE WHEN k % 3 = 0 THEN 'NullPointer:Login' WHEN k % 11 = 0 THEN 'IllegalState:Home' END AS crash_sig,
  CASE WHEN k % 5 < 4 THEN concat('screen', k % 2) END AS screen_sig,
  event_type <> 'click' AS verified,
  CASE WHEN k % 6 > 0 THEN k % 3 END AS changed_files,
  CASE WHEN k % 8 > 0 THEN substr({sha}, 1, 32) END AS change_hash
"""


def attempt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series = user and ten-day span; position within it is the attempt index."""
    from ..operators.ordered import ordered_scan, running_sum, sequence_chunk

    raw = raw_events(spark, sf_dir).withColumn("tens_day", F.floor(F.col("ts_ms") / 864_000_000))
    numbered = ordered_scan(raw, ["user_id", "tens_day"], ["event_id"], sequence_chunk("event_id"), position=running_sum(F.lit(1)))
    return numbered.selectExpr(*_EVIDENCE_COLUMNS.format(sha="sha2(props, 256)").split(",\n"))


EVIDENCE_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
ev4 AS (SELECT *, ts_ms // 864000000 AS tens_day, row_number() OVER (PARTITION BY user_id, ts_ms // 864000000 ORDER BY event_id) AS position FROM ev),
ae AS (SELECT {_EVIDENCE_COLUMNS.format(sha='sha256(props)')} FROM ev4)"""


def contracts(evidence: DataFrame) -> DataFrame:
    """Contracts for the series that start with a crash or a known screen."""
    first = evidence.where("idx = 0")
    return first.where("crash_sig is not null or screen_sig is not null").select(
        "series_id",
        F.col("crash_sig").isNotNull().alias("crash_must_disappear"),
        (F.coalesce("tests_failed", F.lit(0)) > 0).alias("tests_must_decrease"),
        F.when(F.col("crash_sig").isNotNull(), F.lit("screen1")).alias("target_screen"),
        F.col("screen_sig").alias("baseline_screen"),
    )


_RECORD_COLUMNS = """
  concat('r', user_id) AS run_id,
  CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN 'run' WHEN event_type = 'signup' AND k % 3 = 1 THEN 'answer' ELSE 'event' END AS record_kind,
  CASE WHEN event_type = 'signup' AND k % 3 = 1 THEN concat('rc', k % 40) ELSE concat('k', k) END AS record_id,
  concat('file', user_id % 7) AS file,
  event_id AS line_no,
  {sha} AS content_hash,
  CASE WHEN k % 9 = 0 THEN CAST(k AS bigint) END AS declared_sequence,
  CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN CASE k % 5 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'UNKNOWN' ELSE CASE WHEN k < 30 THEN 'COMPLETED' WHEN k < 50 THEN 'FAILED' ELSE 'RUNNING' END END END AS lifecycle,
  concat('an', k % 30) AS answer_id,
  ts_ms
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).selectExpr(*_RECORD_COLUMNS.format(sha="sha2(concat(event_type, props), 256)").split(",\n"))


RECORDS_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
rc0 AS (SELECT {_RECORD_COLUMNS.format(sha='sha256(concat(event_type, props))')} FROM ev),
rc AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY file, line_no) AS sequence FROM rc0)"""


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last assistant turn of a conversation is its final answer; its turns are the scope."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("a"))
    name = F.col("conv_id").cast("string")
    return last.select(
        F.concat(F.lit("rcpt-"), name).alias("receipt_id"),
        F.concat(F.lit("run-"), (F.col("conv_id") % 20).cast("string")).alias("run_id"),
        F.concat(F.lit("ans-"), name).alias("answer_id"),
        F.concat(F.lit("agent-"), (F.col("conv_id") % 3).cast("string")).alias("agent_id"),
        F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("s-"), F.floor(F.col("conv_id") / 4).cast("string"))).alias("agent_session_id"),
        F.concat(F.lit("t-"), F.col("a.turn").cast("string")).alias("turn_id"),
        F.sha2("a.text", 256).alias("answer_hash"),
        F.lit("sha256-sanitized-nfc-lf-v1").alias("hash_version"),
        (F.col("conv_id") * 1000 + F.col("a.turn")).alias("ts_ms"),
        (F.col("conv_id") % 7 > 0).alias("scope_declared"),
        F.col("a.turn").alias("last_turn"),
        "conv_id",
    )


def conversation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are own, others shared; turn 1 of each conversation names an event of its run's pool."""
    own = F.when(F.col("turn") == 1, F.concat(F.lit("pool-"), (F.col("conv_id") % 60).cast("string"))).otherwise(
        F.concat_ws("-", F.lit("ev"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )
    answers = conversation_answers(spark, sf_dir).where("scope_declared").select("receipt_id", "conv_id")
    return table(spark, sf_dir, "conversations").join(answers, "conv_id").select(
        "receipt_id", own.alias("event_id"), F.when(F.col("role") == "assistant", "own").otherwise("shared").alias("scope")
    ).distinct()


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as an event of the run; system turns were never collected."""
    name = F.when(F.col("turn") == 1, F.concat(F.lit("pool-"), (F.col("conv_id") % 60).cast("string"))).otherwise(
        F.concat_ws("-", F.lit("ev"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )
    return (
        table(spark, sf_dir, "conversations")
        .where("role <> 'system'")
        .select(
            F.concat(F.lit("run-"), (F.col("conv_id") % 20).cast("string")).alias("run_id"),
            name.alias("event_id"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("sequence"),
            F.octet_length("text").cast("bigint").alias("n_bytes"),
        )
        .groupBy("run_id", "event_id")
        .agg(F.min("sequence").alias("sequence"), F.min("n_bytes").alias("n_bytes"))
    )


CONVERSATION_SQL = """
la AS (SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1),
an AS (SELECT 'rcpt-' || conv_id AS receipt_id, 'run-' || (conv_id % 20) AS run_id, 'ans-' || conv_id AS answer_id, 'agent-' || (conv_id % 3) AS agent_id,
  CASE WHEN conv_id % 5 > 0 THEN 's-' || (conv_id // 4) END AS agent_session_id, 't-' || turn AS turn_id, sha256(text) AS answer_hash, 'sha256-sanitized-nfc-lf-v1' AS hash_version,
  conv_id * 1000 + turn AS ts_ms, conv_id % 7 > 0 AS scope_declared, conv_id FROM la),
cn AS (SELECT *, CASE WHEN turn = 1 THEN 'pool-' || (conv_id % 60) ELSE 'ev-' || conv_id || '-' || turn END AS event_id FROM conversations),
sc AS (SELECT DISTINCT a.receipt_id, c.event_id, CASE WHEN role = 'assistant' THEN 'own' ELSE 'shared' END AS scope, a.run_id FROM cn c JOIN an a USING (conv_id) WHERE a.scope_declared),
ce AS (SELECT 'run-' || (conv_id % 20) AS run_id, event_id, min(conv_id * 1000 + turn) AS sequence, min(strlen(text)) AS n_bytes FROM cn WHERE role <> 'system' GROUP BY 1, 2),
ss0 AS (SELECT a.receipt_id, a.run_id, a.scope_declared,
  (SELECT count(*) FROM sc s WHERE s.receipt_id = a.receipt_id AND NOT EXISTS (SELECT 1 FROM ce e WHERE e.run_id = a.run_id AND e.event_id = s.event_id)) AS missing,
  (SELECT count(*) FROM sc s JOIN ce e ON e.run_id = a.run_id AND e.event_id = s.event_id WHERE s.receipt_id = a.receipt_id) AS event_count,
  (SELECT count(*) FROM sc s JOIN sc o ON o.event_id = s.event_id AND o.scope = 'own' AND o.receipt_id <> s.receipt_id AND o.run_id = a.run_id WHERE s.receipt_id = a.receipt_id AND s.scope = 'own') AS conflicts,
  (SELECT count(*) FROM sc s WHERE s.receipt_id = a.receipt_id AND scope = 'own') AS own_declared, (SELECT count(*) FROM sc s WHERE s.receipt_id = a.receipt_id AND scope = 'shared') AS shared_declared FROM an a),
ss AS (SELECT *, CASE WHEN scope_declared AND missing = 0 AND conflicts = 0 THEN 'EXPLICIT' ELSE 'UNKNOWN' END AS status FROM ss0)"""


def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context per turn: by session and turn, by receipt, by hash alone, or with nothing useful."""
    text_hash = F.sha2("text", 256)
    kind = F.col("conv_id") % 4 + F.col("turn") % 2 * 4
    name = F.col("conv_id").cast("string")
    is_turn = (kind == 1) | (kind == 5)
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("ctx"), name, F.col("turn").cast("string"), "role").alias("context_id"),
        F.when(is_turn, F.concat(F.lit("agent-"), (F.col("conv_id") % 3).cast("string"))).alias("agent_id"),
        F.when(is_turn, F.concat(F.lit("s-"), F.floor(F.col("conv_id") / 4).cast("string"))).alias("agent_session_id"),
        F.when(is_turn, F.concat(F.lit("t-"), F.col("turn").cast("string"))).alias("turn_id"),
        F.when((kind == 2) | (kind == 6), F.concat(F.lit("rcpt-"), name)).alias("receipt_id"),
        F.when(kind == 6, F.concat(F.lit("run-"), (F.col("conv_id") % 25).cast("string"))).alias("run_id"),
        F.lit(None).cast("string").alias("answer_id"),
        F.when(kind.isin(3, 6, 5), text_hash).alias("answer_hash"),
        F.when(kind.isin(5, 6), F.lit("sha256-sanitized-nfc-lf-v1")).alias("hash_version"),
    )


CONTEXT_SQL = """
cx0 AS (SELECT *, conv_id % 4 + turn % 2 * 4 AS kind FROM conversations),
cx AS (SELECT 'ctx-' || conv_id || '-' || turn || '-' || role AS context_id, CASE WHEN kind IN (1,5) THEN 'agent-' || (conv_id % 3) END AS agent_id, CASE WHEN kind IN (1,5) THEN 's-' || (conv_id // 4) END AS agent_session_id,
  CASE WHEN kind IN (1,5) THEN 't-' || turn END AS turn_id, CASE WHEN kind IN (2,6) THEN 'rcpt-' || conv_id END AS receipt_id, CASE WHEN kind = 6 THEN 'run-' || (conv_id % 25) END AS run_id,
  CASE WHEN kind IN (3,6,5) THEN sha256(text) END AS answer_hash, CASE WHEN kind IN (5,6) THEN 'sha256-sanitized-nfc-lf-v1' END AS hash_version FROM cx0)"""


# ``{a}`` is the list constructor of the dialect; parallel lists are zipped into structs afterwards.
_TRACE_COLUMNS = """
  run_id,
  concat('v', seq) AS event_id,
  seq AS sequence,
  type,
  ts_ms AS occurred_ms,
  CASE WHEN k % 10 = 0 OR (type IN ('CLAIM', 'RECOMMEND') AND k % 3 > 0) THEN 'REPORTED' WHEN k % 10 = 2 THEN 'INFERRED' ELSE 'OBSERVED' END AS category,
  k % 10 >= 3 AS has_locator,
  CASE WHEN type IN ('READ', 'SEARCH') THEN concat('s', k % 15) ELSE concat('t', k % 4) END AS source_id,
  CASE WHEN type = 'READ' THEN 'URL' WHEN type = 'SEARCH' THEN 'UNKNOWN' ELSE 'TOOL_RESULT' END AS source_kind,
  CASE WHEN type = 'READ' THEN CASE WHEN k % 15 = 3 THEN concat('http://10.0.0.3:80/doc/', k % 2) WHEN k % 15 = 4 THEN 'https://web.archive.org/web/2020/https://other9.example.org/'
       ELSE concat('https://Site', k % 15, '.example.com/a//b/?utm_source=x&q=', k % 3, '#top') END END AS location,
  CASE WHEN type = 'READ' AND k % 3 = 0 THEN concat('h', k % 12) END AS content_hash,
  CASE WHEN type = 'READ' AND k % 15 = 3 AND k % 4 > 0 THEN 'Official docs' END AS title,
  CASE WHEN type = 'SEARCH' THEN CASE WHEN k % 10 = 4 THEN '  ' ELSE concat('query ', k % 7, CASE WHEN k % 9 = 0 THEN ' latest' ELSE '' END) END END AS query,
  CASE WHEN type = 'SEARCH' THEN {a}(concat('s', (k + 1) % 15), concat('s', (k + 5) % 15)) END AS hit_ids,
  CASE WHEN type = 'SEARCH' THEN {a}(concat('https://site', (k + 1) % 15, '.example.com/a/b?q=', k % 3), concat('https://other', (k + 5) % 15, '.example.org/')) END AS hit_urls,
  CASE WHEN k % 8 = 0 THEN 'FAILED' WHEN k % 8 = 1 THEN 'CANCELLED' ELSE 'SUCCESS' END AS outcome,
  concat('claim about topic ', k % 90, CASE WHEN k % 6 = 0 THEN ' risk' WHEN k % 6 = 1 THEN ' structure of beta' ELSE '' END) AS claim_text,
  CASE WHEN k % 4 < 3 THEN concat('s', (k * 3) % 15) END AS claim_source,
  CASE WHEN k % 7 = 0 THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS rel_type,
  CASE WHEN type IN ('CLAIM', 'HYPOTHESIS', 'READ') THEN CASE WHEN k % 11 = 0 THEN concat('v', seq + 3) WHEN k % 17 = 0 THEN concat('v', seq) ELSE concat('v', seq - 1 - k % 5) END END AS rel_target,
  CASE WHEN k % 13 = 0 THEN concat('r', k % 5) END AS rel_run,
  {a}(CAST(k AS {s}), CASE WHEN k % 2 = 0 THEN CAST(k * 2 AS {s}) END) AS cell_values,
  {a}(concat('v', seq - 1), concat('v', seq - 2), concat('v', seq - 3)) AS back3,
  {a}(concat('v', seq - 1), concat('v', seq - 2), concat('v', seq - 3), concat('v', seq - 4)) AS back4,
  {a}('region=EU', concat('year>=', 2020 + k % 3)) AS user_conditions,
  CASE WHEN type = 'CONTRADICTION' THEN {a}(concat('v', seq - 1 - k % 3), concat('v', seq - 4 + 8 * CAST(k % 9 = 0 AS int))) END AS conflicting,
  CASE WHEN type = 'CONTRADICTION' THEN CASE k % 4 WHEN 1 THEN {a}('year=2024', 'year=2026') WHEN 2 THEN {a}('year=2024', 'year>=2025') WHEN 3 THEN {a}('some words', 'Some  words') END END AS conditions,
  CASE WHEN k % 3 < 2 THEN concat('v', seq - 1 - k % 6) END AS target_event,
  CASE WHEN k % 3 = 2 THEN concat('Topic ', k % 90) END AS target_text,
  CASE k % 5 WHEN 0 THEN 'INCONCLUSIVE' WHEN 1 THEN 'REFUTED' ELSE 'CONFIRMED' END AS verify_result
"""
_TRACE_TYPE = """CASE event_type WHEN 'view' THEN 'SEARCH' WHEN 'click' THEN 'READ' WHEN 'purchase' THEN 'VERIFY'
  WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 'CONTRADICTION' ELSE 'READ' END
  ELSE CASE WHEN k % 10 < 6 THEN 'CLAIM' WHEN k % 10 = 6 THEN 'RECOMMEND' WHEN k % 10 < 9 THEN 'COMPARE' ELSE 'HYPOTHESIS' END END"""


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import ordered_scan, running_sum, sequence_chunk

    raw = raw_events(spark, sf_dir).select(F.concat(F.lit("r"), F.col("user_id")).alias("run_id"), "event_id", F.expr(_TRACE_TYPE).alias("type"), "k", "ts_ms")
    numbered = ordered_scan(raw, ["run_id"], ["event_id"], sequence_chunk("event_id"), seq=running_sum(F.lit(1)))
    flat = numbered.selectExpr(*_TRACE_COLUMNS.format(a="array", s="string").split(",\n"))
    none = F.lit(None).cast("string")
    cell = lambda i, cand, crit: F.struct(
        F.lit(cand).alias("candidate"), F.lit(crit).alias("criterion"), F.get("cell_values", i).alias("value"), F.col("back3").alias("evidence_event_ids"))
    kind = F.col("type")
    return flat.select(
        "run_id", "event_id", "sequence", "type", "occurred_ms", "category", "has_locator",
        F.struct("source_id", F.col("source_kind").alias("kind"), "location", "content_hash", "title", none.alias("accessed_at")).alias("source"),
        F.when(F.col("rel_target").isNotNull(), F.array(F.struct(F.col("rel_type").alias("type"), F.col("rel_target").alias("target_event_id"), F.col("rel_run").alias("target_run_id")))).alias("relations"),
        F.when(kind == "SEARCH", F.struct("query", F.transform(F.arrays_zip("hit_ids", "hit_urls"), lambda h: F.struct(
            h["hit_ids"].alias("source_id"), none.alias("title"), h["hit_urls"].alias("url"), F.lit(1).alias("rank"))).alias("results"))).alias("search"),
        F.when(kind == "READ", F.struct("source_id", "outcome")).alias("read"),
        F.when(kind == "CLAIM", F.struct(F.col("claim_text").alias("text"), F.col("claim_source").alias("source_id"))).alias("claim"),
        F.when(kind == "COMPARE", F.struct(F.array(cell(0, "alpha", "speed"), cell(1, "beta", "cost")).alias("cells"))).alias("compare"),
        F.when(kind == "RECOMMEND", F.struct(F.lit("alpha").alias("choice"), F.array(F.lit("beta"), F.lit("gamma")).alias("alternatives"), "user_conditions", F.col("back4").alias("rationale_event_ids"))).alias("recommend"),
        F.when(kind == "CONTRADICTION", F.struct(F.col("conflicting").alias("conflicting_event_ids"), "conditions")).alias("contradiction"),
        F.when(kind == "VERIFY", F.struct(F.col("target_event").alias("target_event_id"), F.col("target_text").alias("target_claim_text"), F.col("verify_result").alias("result"), F.col("back3").alias("evidence_event_ids"))).alias("verify"),
    )


def trace_answers(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three answers per run: two own a share of its events and share the rest; the third has no boundary."""
    part = F.pmod(F.floor((F.col("sequence") - 1) / 8), F.lit(3))
    runs = events.groupBy("run_id").agg(F.max("sequence").alias("_n"))
    answers = runs.select(
        "run_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part"), "_n"
    ).select(
        F.concat_ws("-", "run_id", F.col("part").cast("string")).alias("receipt_id"), "run_id", (F.col("part") < 2).alias("scope_declared"),
        F.when(F.col("_n") % 2 == 0, "COMPLETE").otherwise("PARTIAL").alias("completeness"),
        F.when(F.col("part") == 0, F.concat(F.lit("Compare alpha vs beta "), F.col("_n").cast("string"))).when(F.col("part") == 1, "Why is it fresh today").alias("question"),
        F.when((F.col("part") == 1) & (F.col("_n") % 3 == 0), "ASSESS").alias("override"),
    )
    scope = events.select("run_id", "event_id", part.alias("part")).select(
        "run_id", "event_id", "part", F.explode(F.when(F.col("part") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("part").cast("int")))).alias("owner")
    ).select(
        F.concat_ws("-", "run_id", F.col("owner").cast("string")).alias("receipt_id"), "event_id", F.when(F.col("part") == 2, "shared").otherwise("own").alias("scope"),
    )
    return answers, scope


TRACE_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
ev6 AS (SELECT *, 'r' || user_id AS run_id, {_TRACE_TYPE} AS type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM ev),
te AS (SELECT {_TRACE_COLUMNS.format(a='list_value', s='varchar')} FROM ev6),
rn AS (SELECT run_id, max(sequence) AS n FROM te GROUP BY 1),
tq AS (SELECT run_id || '-' || p AS aid, run_id, p < 2 AS declared, CASE WHEN n % 2 = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS completeness,
  CASE p WHEN 0 THEN 'Compare alpha vs beta ' || n WHEN 1 THEN 'Why is it fresh today' END AS question, CASE WHEN p = 1 AND n % 3 = 0 THEN 'ASSESS' END AS override FROM rn, (SELECT unnest([0, 1, 2]) AS p)),
sc AS (SELECT q.aid, t.* FROM te t JOIN tq q USING (run_id) WHERE NOT declared OR ((sequence - 1) // 8) % 3 = 2 OR ((sequence - 1) // 8) % 3 = CAST(split_part(q.aid, '-', 2) AS INT))"""
