"""Registered column-function queries (FN, SAN, CAN, VAL) over the text and event tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commands as C, hashing as H, predicates as Pd, text as X, urls as U
from ..functions.conditions import parse_condition
from ..operators import validate as V
from . import bind

SECRET = "catalog-key"
COMMANDS = (
    "npm run test:unit", "pnpm e2e", "yarn build", "npx vitest run", "adb logcat", "gradlew assembleDebug", "make all", "npm run lint",
    "cargo test --all", "./gradlew connectedTest test", "go build ./...", "ls -la android",
)


def documents(s, d):
    return bind.table(s, d, "documents")


def coded(s, d):
    """Events with texts that spread over what the functions tell apart."""
    pick = F.element_at(F.array(*map(F.lit, COMMANDS)), F.col("k") % len(COMMANDS) + 1)
    k = F.col("k")
    return bind.raw_events(s, d).select(
        "event_id", "user_id", "k", "ts_ms", "event_type",
        pick.alias("command"),
        F.concat(F.lit("C:\\Users\\dev\\proj\\pkg\\src\\t"), (k % 9).cast("string"), F.lit("\\tests\\f"), k.cast("string"), F.lit(".spec.ts")).alias("win_path"),
        F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(" / 120 tests failed"))).when(k % 4 == 1, F.concat(F.lit("ran; "), k.cast("string"), F.lit(" failing")))
        .when(k % 4 == 2, F.concat(F.lit("Tests: "), k.cast("string"), F.lit(" failed, exit code: "), (k % 3).cast("string"))).otherwise("all good, Exit Code 0").alias("output"),
        F.concat(F.lit("*** Begin Patch\n*** Add File: src/a"), k.cast("string"), F.lit(".ts\n+x\n*** Update File: src/b.ts\n-y\n*** End Patch")).alias("patch"),
        F.concat(F.lit("const r = await tools.exec_command(\"echo "), k.cast("string"), F.lit("\"); tools.shell_command(\""), pick, F.lit("\");")).alias("program"),
    )


_CODED = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
co AS (SELECT *, list_extract([{', '.join("'" + c + "'" for c in COMMANDS)}], k % {len(COMMANDS)} + 1) AS command,
  'C:\\Users\\dev\\proj\\pkg\\src\\t' || (k % 9) || '\\tests\\f' || k || '.spec.ts' AS win_path,
  CASE k % 4 WHEN 0 THEN k || ' / 120 tests failed' WHEN 1 THEN 'ran; ' || k || ' failing' WHEN 2 THEN 'Tests: ' || k || ' failed, exit code: ' || (k % 3) ELSE 'all good, Exit Code 0' END AS output FROM ev)"""


def conditions(s, d):
    k = F.col("k")
    raw = F.when(k % 5 == 0, F.concat(F.lit("year >= "), k.cast("string"))).when(k % 5 == 1, F.concat(F.col("event_type"), F.lit("="), k.cast("string"))).when(
        k % 5 == 2, F.concat(F.lit("os: linux "), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("region!=r"), k.cast("string"))).otherwise(F.concat(F.lit("user before "), k.cast("string")))
    return coded(s, d).select("event_id", parse_condition(raw).alias("c")).select("event_id", "c.id", "c.dimension", "c.op", "c.value", "c.key")


def fingerprints(s, d):
    return documents(s, d).select("doc_id", H.change_fingerprint(F.lit("write"), F.array("text"), SECRET).alias("fingerprint"), H.path_fingerprint(F.array("source", "lang"), SECRET).alias("paths"))


def records(s, d):
    """One JSON session event per row, broken in a way that depends on ``k``."""
    k = F.col("k")
    body = F.to_json(F.struct(
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("e"), F.col("event_id"))).alias("id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("sessionId"),
        F.when(k % 7 == 0, "NO_SUCH").otherwise("MESSAGE").alias("type"),
        F.when(k % 13 == 0, "yesterday").otherwise("2026-01-02T03:04:05Z").alias("timestamp"),
        F.when(k % 5 == 0, F.lit(-1.5)).otherwise(F.lit(2.0)).alias("durationMs"),
        F.when(k % 9 == 0, F.lit(1.5)).when(k % 9 == 1, F.lit(3)).alias("exitCode"),
        F.struct((k % 3).alias("n")).alias("metadata"),
    ))
    return coded(s, d).select("event_id", "k", F.when(k % 17 == 0, F.concat(body, F.lit("x"))).otherwise(body).alias("raw"))


def evidence_records(s, d):
    k = F.col("k")
    body = F.to_json(F.struct(
        F.concat(F.lit("a"), k).alias("attemptId"),
        F.struct(F.when(k % 4 == 0, "broken").otherwise("pass").alias("status")).alias("build"),
        F.struct(F.when(k % 5 == 0, F.lit(-1)).otherwise(k).alias("failedCount")).alias("tests"),
        F.struct(F.lit("c").alias("crashSignature"), F.lit("s").alias("screenSignature")).alias("runtime"),
        F.struct((k % 2 == 0).alias("performed")).alias("verification"),
        F.struct(k.alias("changedFilesCount"), F.lit("h").alias("changeSetHash")).alias("code"),
    ))
    return coded(s, d).select("event_id", body.alias("raw"))


def trace_records(s, d):
    """One JSON trace record per row: CLAIM events, run records and receipts, some broken."""
    k, eid = F.col("k"), F.col("event_id")
    head = [
        F.when(k % 10 == 9, F.lit(2)).otherwise(F.lit(1)).alias("schemaVersion"),
        F.when(k % 8 == 7, "con").otherwise(F.concat(F.lit("r"), F.col("user_id"))).alias("runId"),
        F.when(k % 12 == 11, "2026-02-30T00:00:00Z").otherwise("2026-02-03T00:00:00+09:00").alias("occurredAt"),
        F.lit("ad").alias("adapterId"), F.lit("1").alias("adapterVersion"),
    ]
    event = F.to_json(F.struct(
        F.lit("event").alias("recordKind"), *head, F.concat(F.lit("e"), eid).alias("eventId"), F.when(k % 14 == 13, "DANCE").otherwise("CLAIM").alias("type"),
        F.struct(F.lit("p").alias("producer")).alias("origin"),
        F.struct(F.lit("s1").alias("sourceId"), F.lit("URL").alias("kind")).alias("source"),
        F.struct(F.concat(F.lit("TRACE_"), F.when(k % 3 == 0, "OBSERVED").otherwise("REPORTED")).alias("category")).alias("provenance"),
        F.struct(F.when(k % 6 == 5, "").otherwise("a claim").alias("text"), F.lit("hidden").alias("thinking")).alias("payload"),
    ))
    run = F.to_json(F.struct(F.lit("run").alias("recordKind"), *head, F.when(k % 5 == 4, "LOST").otherwise("RUNNING").alias("lifecycle"), F.lit(1).alias("extra")))
    answer = F.to_json(F.struct(
        F.lit("answer").alias("recordKind"), *head, F.lit(1).alias("receiptVersion"), F.concat(F.lit("rc"), eid).alias("receiptId"), F.lit("ag").alias("agentId"),
        F.concat(F.lit("an"), eid).alias("answerId"), F.lit("the answer").alias("answer"), (k % 5 > 0).alias("final"), F.lit("2026-02-03T00:00:00Z").alias("timestamp"),
        F.array(F.lit("e1"), F.when(k % 7 == 6, "e1").otherwise("e2")).alias("eventIds"), F.array(F.when(k % 9 == 8, "e2").otherwise("e3")).alias("sharedEventIds"),
    ))
    return coded(s, d).select("event_id", F.when(eid % 3 == 0, event).when(eid % 3 == 1, run).otherwise(answer).alias("raw"))


def ids(s, d):
    k = F.col("k")
    ident = F.when(k % 6 == 0, "aux").when(k % 6 == 1, F.concat(F.lit("run:"), k.cast("string"))).when(k % 6 == 2, F.concat(F.lit("-"), k.cast("string"))).when(
        k % 6 == 3, F.concat(F.lit("r"), k.cast("string"), F.lit("."))).otherwise(F.concat(F.lit("Run_"), k.cast("string")))
    stamp = F.concat(F.lit("20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("-02-"), F.lpad((k % 31 + 1).cast("string"), 2, "0"), F.lit("T10:"), F.lpad((k % 70).cast("string"), 2, "0"), F.lit(":00"), F.when(k % 4 == 0, "").otherwise("+09:00"))
    return coded(s, d).select("event_id", Pd.is_run_id(ident).alias("run_ok"), Pd.is_event_id(ident).alias("event_ok"), Pd.is_timestamp(stamp).alias("time_ok"))


def bits(s, d):
    k = F.col("k")
    return coded(s, d).select("event_id", X.outcome_runs(F.array(*[k % m == 0 for m in (2, 3, 2, 5, 1)])).alias("label"))


def private(s, d):
    k = F.col("k")
    body = F.to_json(F.struct(F.struct(k.alias("n"), F.lit("no").alias("Reasoning")).alias("a"), F.array(F.struct(F.lit("t").alias("token"), k.alias("v"))).alias("b"), F.concat(F.lit("password=hunter"), k.cast("string")).alias("c")))
    return coded(s, d).select("event_id", V.strip_private(body).alias("s")).select("event_id", "s.body", F.array_join("s.removed", ",").alias("removed"))


def canonical(s, d):
    k = F.col("k")
    body = F.concat(F.lit('{"b": {"z": 1, "a": '), k.cast("string"), F.lit('}, "sequence": '), F.col("event_id").cast("string"), F.lit(', "a": "x"}'))
    return coded(s, d).select("event_id", H.canonical_json(body).alias("canonical"), H.content_hash(body).alias("content_hash"), H.record_hash(body).alias("record_hash"))


_PAYLOADS = ("SEARCH", "READ", "CLAIM", "COMPARE", "HYPOTHESIS", "CONTRADICTION", "VERIFY", "RECOMMEND")


def snippets(s, d):
    """Documents as payloads of the eight types in turn, with their text where a payload has one."""
    k, text = F.col("doc_id"), F.concat(F.lit("\x1b[1m"), "text")
    kind = F.get(F.array(*[F.lit(x) for x in _PAYLOADS]), (k % 8).cast("int"))
    texts = [text.alias(n) for n in ("query", "text", "description", "method", "choice")]
    payload = F.struct(
        kind.alias("type"), (k % 5).alias("results"), F.col("source").alias("source_id"), F.lit("SUCCESS").alias("outcome"), F.array("source", "lang").alias("candidates"),
        (k % 7).alias("cells"), F.lit("CONFIRMED").alias("result"), *texts,
    )
    return documents(s, d).select("doc_id", kind.alias("type"), X.activity_snippet(payload).alias("snippet"))


_SNIPPET = r"""
    WITH c AS (SELECT *, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f\x{80}-\x{9f}]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, ['SEARCH', 'READ', 'CLAIM', 'COMPARE', 'HYPOTHESIS', 'CONTRADICTION', 'VERIFY', 'RECOMMEND'][doc_id % 8 + 1] AS type, CASE doc_id % 8
      WHEN 0 THEN '"' || CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END || '" · ' || (doc_id % 5) || ' result(s)' WHEN 1 THEN source || ' · SUCCESS'
      WHEN 3 THEN source || ' vs ' || lang || ' · ' || (doc_id % 7) || ' cells' WHEN 6 THEN CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END || ' → CONFIRMED'
      WHEN 7 THEN '→ ' || CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END ELSE CASE WHEN length(t) > 140 THEN substr(t, 1, 140) || '…' ELSE t END END AS snippet FROM c"""


QUERIES = {
    "fn_classify_verification": lambda s, d: coded(s, d).select("event_id", C.classify_verification(F.col("command")).alias("kind"), C.is_mobile_command(F.col("command")).alias("mobile")),
    "fn_output_numbers": lambda s, d: coded(s, d).select("event_id", C.extract_failed_count(F.col("output")).alias("failed"), C.exit_code(F.col("output")).alias("exit_code")),
    "fn_failure_signature": lambda s, d: documents(s, d).select("doc_id", C.failure_signature(F.col("text")).alias("signature")),
    "fn_display_path": lambda s, d: coded(s, d).select("event_id", C.display_path(F.col("win_path")).alias("plain"), C.display_path(F.col("win_path"), F.lit("c:\\users\\dev\\proj\\")).alias("relative"), C.is_test_path(C.display_path(F.col("win_path"))).alias("is_test")),
    "fn_first_line": lambda s, d: documents(s, d).select("doc_id", X.first_line(F.col("text")).alias("line")),
    "fn_patch_files": lambda s, d: coded(s, d).select("event_id", F.inline(C.patch_files(F.col("patch")))),
    "fn_embedded_command": lambda s, d: coded(s, d).select("event_id", C.embedded_command(F.col("program")).alias("c")).select("event_id", "c.kind", "c.command"),
    "fn_change_fingerprint": fingerprints,
    "fn_normalize_location": lambda s, d: bind.table(s, d, "pages").select("page_id", U.normalize_location(F.col("url")).alias("location")),
    "fn_archive_location": lambda s, d: bind.table(s, d, "pages").select("page_id", U.archive_embedded_location(U.normalize_location(F.concat(F.lit("https://web.archive.org/web/20200101/"), "url"))).alias("original")),
    "fn_parse_condition": conditions,
    "fn_infer_mode": lambda s, d: documents(s, d).select("doc_id", X.infer_mode(F.col("text")).alias("mode")),
    "fn_labels": lambda s, d: coded(s, d).select("event_id", X.clean_label(F.concat(F.lit("ran cd /tmp/x && "), "command", F.lit("   and more words than fit in a row"))).alias("label"), X.is_harness_text(F.concat(F.when(F.col("k") % 2 == 0, "/model ").otherwise("fix "), "command")).alias("harness"), X.is_task_shaped(F.col("command")).alias("task_shaped")),
    "fn_duration_labels": lambda s, d: coded(s, d).select("event_id", X.duration_label(F.col("ts_ms") % 9_000_000).alias("clock"), X.duration_words((F.col("ts_ms") % 9_000_000) * (F.col("k") + 1)).alias("words")),
    "fn_outcome_runs": bits,
    "fn_scope_hash": lambda s, d: coded(s, d).select("event_id", H.scope_hash(F.when(F.col("k") % 5 > 0, F.array(F.concat(F.lit("b"), "k"), F.concat(F.lit("a"), "user_id")))).alias("scope"), H.state_revision(scope=F.col("user_id"), count=F.col("k")).alias("state")),
    "san_redact_secrets": lambda s, d: documents(s, d).select("doc_id", F.sha2(X.redact_secrets(F.col("text")), 256).alias("redacted"), (X.redact_secrets(F.col("text")) != F.col("text")).alias("changed")),
    "san_sanitize_text": lambda s, d: documents(s, d).select("doc_id", X.sanitize_text(F.concat(F.lit("\x1b[31m"), "text", F.lit("\x07"))).alias("clean")),
    "fn_activity_snippet": snippets,
    "san_signature": lambda s, d: documents(s, d).select("doc_id", X.sanitize_signature(F.col("text")).alias("signature")),
    "san_strip_private": private,
    "can_canonical_json": canonical,
    "can_answer_hash": lambda s, d: bind.table(s, d, "conversations").select("conv_id", "turn", H.answer_hash(F.col("text")).alias("answer_hash")),
    "can_native_id": lambda s, d: coded(s, d).select("event_id", H.native_id(F.col("event_type"), F.col("user_id").cast("string")).alias("native_id")),
    "val_ids_and_times": ids,
    "val_session_events": lambda s, d: V.validate_session_events(records(s, d))[1].select("event_id", F.size("errors").alias("errors"), F.get("errors", 0).alias("first_error")),
    "val_session_events_valid": lambda s, d: V.validate_session_events(records(s, d))[0].select("event_id"),
    "val_evidence": lambda s, d: V.validate_evidence(evidence_records(s, d))[1].select("event_id", F.array_join("errors", "; ").alias("errors")),
    "val_trace_records": lambda s, d: V.validate_records(trace_records(s, d), "TRACE_")[1],
    "val_trace_records_valid": lambda s, d: V.validate_records(trace_records(s, d), "TRACE_")[0].select("event_id"),
}


def _co(final):
    return f"WITH {_CODED}\n{final}"


def _hmac(body):
    key = SECRET.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({body})))), 1, 32)"


_CLASS = r"""CASE WHEN regexp_matches(command, '(?i)\b((?:npm|pnpm|yarn|bun)(?:\s+run)?\s+(?:test|tests|spec|e2e|unit)(?::[\w:.-]+)?\b|jest\b|vitest\b|pytest\b|node --test\b|playwright\b|go test\b|cargo test\b|gradlew?(?:\.bat)?\b[^|;&]*\btest\b|mvn\b[^|;&]*\btest\b|dotnet test\b)') THEN 'test'
  WHEN regexp_matches(command, '(?i)\b(adb(?:\.exe)?\s|agent-device\s|emulator\s|maestro\s|xcrun\s)') THEN 'device'
  WHEN regexp_matches(command, '(?i)\b((?:npm|pnpm|yarn|bun)(?:\s+run)?\s+(?:build|typecheck|type-check|tsc|compile|check|verify|ci)(?::[\w:.-]+)?\b|gradlew?(?:\.bat)?\s|gradle\s|mvn\s|make\b|cmake\b|tsc\b|go build\b|dotnet build\b|cargo build\b)') THEN 'build' END"""
_REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{16,})\b', '[REDACTED]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/-]{8,}', 'Bearer [REDACTED]', 'g'),
  '(?i)((?:api[_-]?key|access[_-]?token|refresh[_-]?token|token|password|secret|authorization)\s*[=:]\s*["'']?)[^\s&"''<>]+', '\1[REDACTED]', 'g'), '(?i)(https?://)[^\s/@]+:[^\s/@]+@', '\1[REDACTED]@', 'g')"""
_MODES = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{m}'" for m, p in X.QUESTION_MODES) + " ELSE 'UNKNOWN' END"
# Page addresses: scheme, host, path, query; tracking dropped, query sorted by key.
_NORM = r"""(SELECT regexp_extract(u, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN p = '' THEN '/' WHEN length(p) > 1 AND suffix(p, '/') THEN substr(p, 1, length(p) - 1) ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END FROM (
   SELECT u, regexp_replace(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS p,
     coalesce(array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|ref|ref_src|fbclid|gclid|mc_eid|igshid)='))), '&'), '') AS q FROM (SELECT URL AS u)))"""
_CLOCK = "CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END"
_WORDS = """CASE WHEN ms <= 0 THEN 'n/a' WHEN ms < 60000 THEN CAST(CAST(floor(ms/1000.0+0.5) AS BIGINT) AS VARCHAR) || ' s' WHEN ms/60000.0 < 90 THEN CAST(CAST(floor(ms/60000.0+0.5) AS BIGINT) AS VARCHAR) || ' min'
  WHEN ms // 3600000 < 48 THEN (ms // 3600000) || ' h ' || CAST(CAST(floor(ms/60000.0 - (ms // 3600000)*60 + 0.5) AS BIGINT) AS VARCHAR) || ' min' ELSE (ms // 86400000) || 'd ' || ((ms // 3600000) % 24) || ' h*' END"""

ORACLES = {
    "fn_classify_verification": _co(f"SELECT event_id, {_CLASS} AS kind, regexp_matches(command, '(?i)\\b(adb(?:\\.exe)?\\s|gradlew?(?:\\.bat)?\\b|emulator\\b|agent-device\\s|logcat\\b|\\.apk\\b|aapt\\d?\\s|android\\b|com\\.android\\.\\w+)') AS mobile FROM co"),
    "fn_output_numbers": _co("SELECT event_id, CASE WHEN k % 4 < 3 THEN k END AS failed, CASE k % 4 WHEN 2 THEN k % 3 WHEN 3 THEN 0 END AS exit_code FROM co"),
    "fn_failure_signature": r"""WITH m AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z]:\\[^\s"'']+', '<PATH>', 'g'), '(?:/(?:home|Users|root|tmp|var|mnt)/\S+)', '<PATH>', 'g'), '(?i)\b[0-9a-f]{8,}\b', '<HEX>', 'g'), '\b\d+(?:\.\d+)?\b', '<N>', 'g'), '\r?\n'),
       lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 3 AND NOT regexp_matches(x, '(?i)^(?:(?:script|command|shell|exec(?:ution)?)\s+(?:failed|completed|error)?\s*[:]?|wall time:? <N>(?: seconds)?|output:?|exit code[:\s]*<N>|process exited(?: with code <N>)?|failed|error|<N>)\s*$')) AS l FROM documents)
       SELECT doc_id, substr(sha256(CASE WHEN len(l) = 0 THEN '<opaque-failure>' ELSE array_to_string(l[-3:], chr(10)) END), 1, 8) AS signature FROM m""",
    "fn_display_path": _co("SELECT event_id, '…/t' || (k % 9) || '/tests/f' || k || '.spec.ts' AS plain, 'pkg/src/t' || (k % 9) || '/tests/f' || k || '.spec.ts' AS relative, TRUE AS is_test FROM co").replace("'…/t' ||", "'…/src/t' ||").replace("'pkg/src/t' || (k % 9) || '/tests/f' || k || '.spec.ts' AS relative", "'…/src/t' || (k % 9) || '/tests/f' || k || '.spec.ts' AS relative"),
    "fn_first_line": r"SELECT doc_id, CASE WHEN length(l) > 160 THEN substr(l, 1, 159) || '…' ELSE nullif(l, '') END AS line FROM (SELECT doc_id, regexp_replace(regexp_extract(regexp_replace(text, '\\+', '/', 'g'), '(\S[^\n]*)', 1), '\s+$', '') AS l FROM documents)",
    "fn_patch_files": _co("SELECT event_id, 'add' AS op, 'src/a' || k || '.ts' AS path FROM co UNION ALL SELECT event_id, 'update', 'src/b.ts' FROM co"),
    # The window of the first call reaches over the second one, so its strings join both commands.
    "fn_embedded_command": _co("SELECT event_id, kind, CASE WHEN kind IS NOT NULL THEN command END AS command FROM (SELECT event_id, " + _CLASS + " AS kind, command FROM (SELECT event_id, 'echo ' || k || ' ' || command AS command FROM co))"),
    "fn_change_fingerprint": r"SELECT doc_id, " + _hmac("""'{"v":2,"op":"write","parts":[' || CAST(to_json(regexp_replace(text, '\r\n?', chr(10), 'g')) AS VARCHAR) || ']}'""") + " AS fingerprint, " + _hmac("""'{"v":2,"op":"paths","paths":[' || array_to_string(list_transform(list_sort([source, lang]), lambda x: '"' || x || '"'), ',') || ']}'""") + " AS paths FROM documents",
    "fn_normalize_location": "SELECT page_id, " + _NORM.replace("URL", "url") + " AS location FROM pages",
    "fn_archive_location": "SELECT page_id, " + _NORM.replace("URL", "regexp_replace(url, '[?#].*$', '')") + " AS original FROM pages",
    "fn_parse_condition": _co("""SELECT event_id, 'cond-' || regexp_replace(key, '[^a-z0-9-]', '-', 'g') || '-' || substr(sha256(key || ':' || op || ':' || value), 1, 12) AS id, dimension, op, value, key FROM (
       SELECT event_id, CASE k % 5 WHEN 0 THEN 'TIME' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'ENVIRONMENT' WHEN 3 THEN 'REGION' ELSE 'USER_REQUIREMENT' END AS dimension, CASE k % 5 WHEN 0 THEN 'AFTER' WHEN 1 THEN 'EQ' WHEN 2 THEN 'EQ' WHEN 3 THEN 'NEQ' ELSE 'BEFORE' END AS op,
         CASE k % 5 WHEN 2 THEN 'linux ' || k WHEN 3 THEN 'r' || k ELSE CAST(k AS VARCHAR) END AS value, CASE k % 5 WHEN 0 THEN 'time' WHEN 1 THEN 'other:' || event_type WHEN 2 THEN 'environment' WHEN 3 THEN 'region' ELSE 'user_requirement' END AS key FROM co)"""),
    "fn_infer_mode": f"SELECT doc_id, {_MODES} AS mode FROM documents",
    "fn_labels": _co("SELECT event_id, CASE WHEN length(l) > 48 THEN substr(l, 1, 47) || '…' ELSE l END AS label, k % 2 = 0 AS harness, TRUE AS task_shaped FROM (SELECT *, 'ran ' || command || ' and more words than fit in a row' AS l FROM co)"),
    "fn_duration_labels": _co(f"SELECT event_id, {_CLOCK} AS clock, {_WORDS} AS words FROM (SELECT event_id, CAST(floor((ts_ms % 9000000) / 1000.0 + 0.5) AS BIGINT) AS s, (ts_ms % 9000000) * (k + 1) AS ms FROM co)"),
    "fn_outcome_runs": _co("""SELECT event_id, array_to_string(list_transform(list_filter(range(1, 6), lambda i: i = 1 OR l[i] <> l[i - 1]), lambda i: CASE WHEN l[i] THEN 'PASS' ELSE 'FAIL' END
       || CASE WHEN coalesce(list_filter(range(i + 1, 6), lambda j: l[j] <> l[i])[1], 6) - i > 1 THEN ' ×' || (coalesce(list_filter(range(i + 1, 6), lambda j: l[j] <> l[i])[1], 6) - i) ELSE '' END), ' → edit → ') AS label FROM (SELECT event_id, [k % 2 = 0, k % 3 = 0, k % 2 = 0, k % 5 = 0, TRUE] AS l FROM co)"""),
    "fn_scope_hash": _co("""SELECT event_id, sha256(CASE WHEN k % 5 > 0 THEN array_to_string(list_sort(['b' || k, 'a' || user_id]), chr(10)) ELSE 'run-container' END) AS scope, sha256('{"count":' || k || ',"scope":' || user_id || '}') AS state FROM co"""),
    "san_redact_secrets": f"SELECT doc_id, sha256({_REDACT}) AS redacted, {_REDACT} <> text AS changed FROM documents",
    "san_sanitize_text": r"SELECT doc_id, CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '…' ELSE c END AS clean FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f\x{80}-\x{9f}]', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM documents)",
    "fn_activity_snippet": _SNIPPET,
    "san_signature": r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), '\s+', ' ', 'g')), 1, 120) AS signature FROM documents",
    "san_strip_private": _co("""SELECT event_id, '{"a":{"n":' || k || '},"b":[{"v":' || k || '}],"c":"password=[REDACTED]"}' AS body, 'a.Reasoning,b[0].token' AS removed FROM co"""),
    "can_canonical_json": _co("""SELECT event_id, '{"a":"x","b":{"a":' || k || ',"z":1},"sequence":' || event_id || '}' AS canonical, sha256('{"a":"x","b":{"a":' || k || ',"z":1}}') AS content_hash, sha256('{"a":"x","b":{"a":' || k || ',"z":1},"sequence":' || event_id || '}') AS record_hash FROM co"""),
    "can_answer_hash": f"SELECT conv_id, turn, sha256(nfc_normalize(regexp_replace({_REDACT}, '\\r\\n?', chr(10), 'g'))) AS answer_hash FROM conversations",
    "can_native_id": _co("""SELECT event_id, substr(sha256('["' || event_type || '","' || user_id || '"]'), 1, 40) AS native_id FROM co"""),
    "val_ids_and_times": _co("SELECT event_id, k % 6 >= 4 AS run_ok, k % 6 <> 2 AS event_ok, k % 4 <> 0 AND k % 70 < 60 AND k % 31 + 1 <= CASE WHEN (k % 30) % 4 = 0 THEN 29 ELSE 28 END AS time_ok FROM co"),
    "val_session_events": _co("""SELECT event_id, CASE WHEN k % 17 = 0 THEN 1 ELSE CAST(k % 11 = 0 AS INT) + CAST(k % 7 = 0 AS INT) + CAST(k % 13 = 0 AS INT) + CAST(k % 5 = 0 AS INT) + CAST(k % 9 = 0 AS INT) END AS errors,
       CASE WHEN k % 17 = 0 THEN 'event must be an object' WHEN k % 11 = 0 THEN 'id must be a non-empty string' WHEN k % 7 = 0 THEN 'type must be a known event type' WHEN k % 13 = 0 THEN 'timestamp must be an ISO 8601 string'
         WHEN k % 5 = 0 THEN 'durationMs must be a non-negative finite number or null' ELSE 'exitCode must be an integer or null' END AS first_error FROM co WHERE k % 17 = 0 OR k % 11 = 0 OR k % 7 = 0 OR k % 13 = 0 OR k % 5 = 0 OR k % 9 = 0"""),
    "val_session_events_valid": _co("SELECT event_id FROM co WHERE NOT (k % 17 = 0 OR k % 11 = 0 OR k % 7 = 0 OR k % 13 = 0 OR k % 5 = 0 OR k % 9 = 0)"),
    "val_evidence": _co("SELECT event_id, concat_ws('; ', CASE WHEN k % 4 = 0 THEN 'build.status must be pass, fail, unknown or null' END, CASE WHEN k % 5 = 0 THEN 'tests.failedCount must be a non-negative integer or null' END) AS errors FROM co WHERE k % 4 = 0 OR k % 5 = 0"),
    "val_trace_records": _co("""SELECT event_id, 'FUTURE_SCHEMA_VERSION' AS code, 'error' AS severity, 'schemaVersion' AS field FROM co WHERE k % 10 = 9 UNION ALL SELECT event_id, 'INVALID_RUN_ID', 'error', 'runId' FROM co WHERE k % 8 = 7
       UNION ALL SELECT event_id, 'INVALID_TIME', 'error', 'occurredAt' FROM co WHERE k % 12 = 11 UNION ALL SELECT event_id, 'INVALID_FIELD', 'error', 'type' FROM co WHERE event_id % 3 = 0 AND k % 14 = 13
       UNION ALL SELECT event_id, 'EMPTY_ID', 'error', 'payload.text' FROM co WHERE event_id % 3 = 0 AND k % 6 = 5 AND k % 14 <> 13 UNION ALL SELECT event_id, 'SOURCE_LOCATION_MISSING', 'warning', NULL FROM co WHERE event_id % 3 = 0
       UNION ALL SELECT event_id, 'OBSERVED_WITHOUT_LOCATION', 'warning', NULL FROM co WHERE event_id % 3 = 0 AND k % 3 = 0 UNION ALL SELECT event_id, 'REDACTED_PRIVATE_FIELD', 'info', NULL FROM co WHERE event_id % 3 = 0
       UNION ALL SELECT event_id, 'INVALID_FIELD', 'error', 'lifecycle' FROM co WHERE event_id % 3 = 1 AND k % 5 = 4 UNION ALL SELECT event_id, 'UNKNOWN_FIELD_DROPPED', 'info', NULL FROM co WHERE event_id % 3 = 1
       UNION ALL SELECT event_id, 'ANSWER_NOT_FINAL', 'error', 'final' FROM co WHERE event_id % 3 = 2 AND k % 5 = 0 UNION ALL SELECT event_id, 'INVALID_SCOPE', 'error', 'scope' FROM co WHERE event_id % 3 = 2 AND k % 7 = 6
       UNION ALL SELECT event_id, 'INVALID_SCOPE', 'error', 'disjoint' FROM co WHERE event_id % 3 = 2 AND k % 9 = 8 AND k % 7 <> 6"""),
    "val_trace_records_valid": _co("SELECT event_id FROM co WHERE k % 10 <> 9 AND k % 8 <> 7 AND k % 12 <> 11 AND CASE event_id % 3 WHEN 0 THEN k % 14 <> 13 AND k % 6 <> 5 WHEN 1 THEN k % 5 <> 4 ELSE k % 5 <> 0 AND k % 7 <> 6 AND k % 9 <> 8 END"),
}
