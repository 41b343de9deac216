"""Validation of raw JSON records. Rules read the VARIANT, so a value of the wrong JSON type is seen.

Each rule set is one array of optional codes per row: no row is read twice, and the list of all
problems comes out with the verdict.
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import answer_hash
from ..functions.predicates import is_event_id, is_run_id, is_timestamp
from ..functions.text import redact_secrets
from ..runtime import spread, stage
from ..schemas import EVENT_STATUSES, EVENT_TYPES

# Field names that never enter the store, in lower case.
PRIVATE_FIELDS = (
    "reasoning", "reasoning_content", "reasoning_text", "thinking", "thinking_delta", "thought", "thoughts", "analysis",
    "analysis_content", "private_reasoning", "internal_monologue", "encrypted_content", "encrypted_reasoning", "cot",
    "chain_of_thought", "signature",
)
SECRET_FIELDS = (
    "apikey", "api_key", "api-key", "access_token", "refresh_token", "authorization", "password", "secret", "credentials", "token",
)
# Closed vocabularies of trace records.
DOMAIN_TYPES = ("SEARCH", "READ", "CLAIM", "COMPARE", "HYPOTHESIS", "CONTRADICTION", "VERIFY", "RECOMMEND")
LIFECYCLES = ("CREATED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "UNKNOWN")
OPERATION_STATUSES = ("SUCCESS", "FAILED", "PARTIAL", "TIMEOUT", "CANCELLED", "UNKNOWN")
VERIFY_RESULTS = ("CONFIRMED", "REFUTED", "INCONCLUSIVE", "UNKNOWN")
RELATION_TYPES = ("SUPPORTS", "REFUTES", "VERIFIES", "CONTRADICTS", "BASED_ON", "CITES", "COMPARED", "RESOLVES")
SOURCE_KINDS = ("URL", "FILE", "TOOL_RESULT", "DOCUMENT", "OTHER", "UNKNOWN")
SCHEMA_VERSION = 1
MAX_RECORD_BYTES = 1 << 20
EVENT_FIELDS = (
    "recordKind", "schemaVersion", "eventId", "runId", "type", "occurredAt", "sequence", "receivedAt", "adapterId", "adapterVersion",
    "origin", "source", "provenance", "payload", "relations",
)
RUN_FIELDS = ("recordKind", "schemaVersion", "runId", "lifecycle", "occurredAt", "sequence", "receivedAt", "adapterId", "adapterVersion", "detail")
ANSWER_FIELDS = (
    "recordKind", "schemaVersion", "receiptVersion", "receiptId", "runId", "agentId", "agentSessionId", "turnId", "answerId", "answer",
    "answerHash", "hashVersion", "final", "timestamp", "occurredAt", "receivedAt", "sequence", "adapterId", "adapterVersion",
    "questionSummary", "eventIds", "sharedEventIds",
)


def parse_strict(body: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value; null otherwise.

    ``try_parse_json`` stops at the end of the first value, so the text is read as the single element
    of a list, which trailing text breaks.
    """
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(wrapped) == 1, F.get(wrapped, 0))


class Field:
    """A JSON value under test: kind, text, number, and the value itself."""

    def __init__(self, k: Column, t: Column, n: Column, v: Column):
        self.k, self.t, self.n, self.v = k, t, n, v


class Probed:
    """A path of a document: each part that a rule reads is asked for by name, and only those are probed."""

    def __init__(self, doc: Doc, path: str):
        self.doc, self.path = doc, path

    def __getattr__(self, part: str) -> Column:
        if part not in ("k", "t", "n", "v"):
            raise AttributeError(part)
        return self.doc.part(self.path, part)


def _kind_of(x: Column) -> Column:
    """Kind of a value. Its JSON text would tell too, but costs a generator for each string."""
    name = F.schema_of_variant(x)
    return (
        F.when(name == "STRING", "STRING").when(F.startswith(name, F.lit("OBJECT")), "OBJECT").when(F.startswith(name, F.lit("ARRAY")), "ARRAY")
        .when(name.isin("BOOLEAN", "VOID"), name).when(name.isNotNull(), "NUMBER")
    )


def _probe(x: Column) -> dict[str, Column]:
    return {
        "k": _kind_of(x),
        "t": F.try_variant_get(x, "$", "string"),
        "n": F.try_variant_get(x, "$", "double"),
        "v": x,
    }


class Doc:
    """A document whose tested paths are each probed once per row, in one projection before the rules.

    ``fields`` names the fields of each record kind, if there are any: a path below one is looked for in records of those kinds only.
    """

    def __init__(self, column: str, fields: dict[str, tuple[str, ...]] | None = None):
        self.column, self.of_kind, self.fields, self.parts, self.known = column, fields or {}, {}, {}, {}

    def get(self, path: str) -> Probed:
        return self.fields.setdefault(path, Probed(self, path))

    def part(self, path: str, part: str) -> Column:
        if (path, part) not in self.parts:
            self.parts[path, part] = f"_f{len(self.parts)}{part}"
        return F.col(self.parts[path, part])

    def place(self, path: str) -> Column:
        v = F.col(self.column)
        if path == "":
            return v
        found = F.try_variant_get(v, f"$.{path}", "variant")
        kinds = [k for k, names in self.of_kind.items() if path.split(".")[0] in names]
        return F.when(F.col("_kind").isin(*kinds), found) if 0 < len(kinds) < len(self.of_kind) else found

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the probes that were asked for; call it after the rules are built."""
        base = df.columns
        if self.of_kind:
            df = df.withColumn("_kind", F.try_variant_get(self.column, "$.recordKind", "string"))
        places = {p: f"_p{i}" for i, p in enumerate(dict.fromkeys(p for p, _ in self.parts))}
        df = df.withColumns({n: self.place(p) for p, n in places.items()})
        # Written once: hundreds of rules read the probes, and the optimizer would otherwise fold each
        # probe back into every rule that uses it.
        return stage(df.select(*base, *[_probe(F.col(places[p]))[part].alias(n) for (p, part), n in self.parts.items()]))


def _once(test):
    """A test of a path of a document is built once, however many rules ask for it."""
    @functools.wraps(test)
    def ask(x):
        if isinstance(x, Doc):
            x = x.get("")
        if not isinstance(x, Probed):
            return test(x)
        key = (test.__name__, x.path)
        if key not in x.doc.known:
            x.doc.known[key] = test(x)
        return x.doc.known[key]

    return ask


def _as(x: Field | Probed | Doc | Column) -> Field | Probed:
    if isinstance(x, Doc):
        return x.get("")
    return x if isinstance(x, Field | Probed) else Field(**_probe(x))


def at(base: Field | Probed | Doc | Column, path: str) -> Field | Probed:
    if isinstance(base, Doc):
        return base.get(path)
    if isinstance(base, Probed):
        return base.doc.get(f"{base.path}.{path}")
    return _as(F.try_variant_get(base.v if isinstance(base, Field) else base, f"$.{path}", "variant"))


@_once
def absent(x) -> Column:
    """Only what is there has a kind."""
    return _as(x).k.isNull()


@_once
def is_null(x) -> Column:
    """Absent or JSON null."""
    return F.coalesce(_as(x).k == "VOID", F.lit(True))


@_once
def is_json_null(x) -> Column:
    return F.coalesce(_as(x).k == "VOID", F.lit(False))


@_once
def is_string(x) -> Column:
    return F.coalesce(_as(x).k == "STRING", F.lit(False))


@_once
def is_number(x) -> Column:
    return F.coalesce(_as(x).k.isin("NUMBER"), F.lit(False))


@_once
def is_bool(x) -> Column:
    return F.coalesce(_as(x).k == "BOOLEAN", F.lit(False))


@_once
def is_object(x) -> Column:
    return F.coalesce(_as(x).k == "OBJECT", F.lit(False))


@_once
def is_array(x) -> Column:
    return F.coalesce(_as(x).k == "ARRAY", F.lit(False))


def text(x) -> Column:
    return _as(x).t


def number(x) -> Column:
    return _as(x).n


@_once
def is_integer(x) -> Column:
    x = _as(x)
    return is_number(x) & F.coalesce(x.n == F.floor(x.n), F.lit(False))


@_once
def items(x) -> Column:
    x = _as(x)
    return F.coalesce(F.when(is_array(x), F.try_variant_get(x.v, "$", "array<variant>")), F.array().cast("array<variant>"))


@_once
def keys(x) -> Column:
    x = _as(x)
    return F.coalesce(F.map_keys(F.when(is_object(x), F.try_variant_get(x.v, "$", "map<string,variant>"))), F.array().cast("array<string>"))


def one_of(x, values: tuple[str, ...]) -> Column:
    return is_string(x) & F.coalesce(text(x).isin(*values), F.lit(False))


@_once
def string_list(x) -> Column:
    """Absent, or an array of non-empty strings."""
    return absent(x) | (is_array(x) & F.forall(items(x), lambda i: is_string(i) & (text(i) != "")))


def _broken(rules: list[tuple[Column, str]]) -> Column:
    # a filter by a lambda would have Spark interpret all rules instead of compiling them
    return F.array_remove(F.array(*[F.when(F.coalesce(bad, F.lit(True)), code).otherwise("") for bad, code in rules]), "")


def validate_session_events(raw: DataFrame, body: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Rows with a valid session event (parsed as ``v``), and the others with all their ``errors``."""
    v = Doc("v")

    def opt_string(name):
        return ~(is_null(at(v, name)) | is_string(at(v, name)))

    duration, code = at(v, "durationMs"), at(v, "exitCode")
    related = at(v, "relatedEventIds")
    rules = [
        (~is_string(at(v, "id")) | (text(at(v, "id")) == ""), "id must be a non-empty string"),
        (~is_string(at(v, "sessionId")) | (text(at(v, "sessionId")) == ""), "sessionId must be a non-empty string"),
        (~one_of(at(v, "type"), EVENT_TYPES), "type must be a known event type"),
        (~is_string(at(v, "timestamp")) | text(at(v, "timestamp")).try_cast("timestamp").isNull(), "timestamp must be an ISO 8601 string"),
        (opt_string("agentId") | (is_string(at(v, "agentId")) & (text(at(v, "agentId")) == "")), "agentId must be a non-empty string when present"),
        (opt_string("parentAgentId"), "parentAgentId must be a string or null"),
        (opt_string("parentId"), "parentId must be a string or null"),
        (~(is_null(duration) | (is_number(duration) & (number(duration) >= 0))), "durationMs must be a non-negative finite number or null"),
        (~(is_null(code) | is_integer(code)), "exitCode must be an integer or null"),
        *[(opt_string(n), f"{n} must be a string or null") for n in ("summary", "filePath", "command", "toolName", "error")],
        (~(is_null(at(v, "status")) | one_of(at(v, "status"), EVENT_STATUSES)), "status must be a known status"),
        (~(is_null(at(v, "metadata")) | is_object(at(v, "metadata"))), "metadata must be an object or null"),
        (~(is_null(related) | (is_array(related) & F.forall(items(related), is_string))), "relatedEventIds must be an array of strings"),
    ]
    errors = F.when(~is_object(v), F.array(F.lit("event must be an object"))).otherwise(_broken(rules))
    rows = v.attach(raw.withColumn("v", parse_strict(F.col(body))))
    checked = rows.select(*raw.columns, "v", errors.alias("errors"))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0).drop("v")


def validate_evidence(raw: DataFrame, body: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Attempt evidence with the shape attemptId, build, tests, runtime, verification, code."""
    v = Doc("v")

    def count(x):
        return is_null(x) | (is_integer(x) & (number(x) >= 0))

    def nullable_string(x):
        return is_json_null(x) | is_string(x)

    def inside(name, rule, message):
        return (is_object(at(v, name)) & ~rule, message)

    rules = [
        (~is_string(at(v, "attemptId")) | (text(at(v, "attemptId")) == ""), "attemptId must be a non-empty string"),
        *[(~is_object(at(v, n)), f"{n} must be an object") for n in ("build", "tests", "runtime", "verification", "code")],
        inside("build", is_null(at(v, "build.status")) | one_of(at(v, "build.status"), ("pass", "fail", "unknown")), "build.status must be pass, fail, unknown or null"),
        inside("tests", count(at(v, "tests.failedCount")), "tests.failedCount must be a non-negative integer or null"),
        inside("runtime", nullable_string(at(v, "runtime.crashSignature")), "runtime.crashSignature must be a string or null"),
        inside("runtime", nullable_string(at(v, "runtime.screenSignature")), "runtime.screenSignature must be a string or null"),
        inside("verification", is_bool(at(v, "verification.performed")), "verification.performed must be a boolean"),
        inside("code", count(at(v, "code.changedFilesCount")), "code.changedFilesCount must be a non-negative integer or null"),
        inside("code", nullable_string(at(v, "code.changeSetHash")), "code.changeSetHash must be a string or null"),
    ]
    errors = F.when(~is_object(v), F.array(F.lit("evidence must be an object"))).otherwise(_broken(rules))
    rows = v.attach(raw.withColumn("v", parse_strict(F.col(body))))
    checked = rows.select(*raw.columns, "v", errors.alias("errors"))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0).drop("v")


_STRIPPED = T.StructType([T.StructField("body", T.StringType()), T.StructField("removed", T.ArrayType(T.StringType()))])


@F.pandas_udf(_STRIPPED)
def _strip(bodies: pd.Series) -> pd.DataFrame:
    gone = set(PRIVATE_FIELDS) | set(SECRET_FIELDS)

    def walk(value, path, removed):
        if isinstance(value, list):
            return [walk(x, f"{path}[{i}]", removed) for i, x in enumerate(value)]
        if isinstance(value, dict):
            kept = {}
            for k, x in value.items():
                here = f"{path}.{k}" if path else k
                if k.lower() in gone:
                    removed.append(here)
                else:
                    kept[k] = walk(x, here, removed)
            return kept
        return value

    out = []
    for body in bodies:
        removed: list[str] = []
        try:
            cleaned = json.dumps(walk(json.loads(body), "", removed), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            cleaned = None
        out.append((cleaned, removed))
    return pd.DataFrame({"body": pd.Series([b for b, _ in out], dtype=object), "removed": pd.Series([r for _, r in out], dtype=object)})


def strip_private(body: Column) -> Column:
    """``struct<body,removed>``: private and secret fields gone at any depth, secrets in text redacted.

    A rewrite at unknown depth has no built-in, so a batched function walks the record; the redaction
    of secrets in text stays a built-in expression.
    """
    s = _strip(body)
    return F.struct(redact_secrets(s["body"]).alias("body"), s["removed"].alias("removed"))


def _id_rules(v, name: str, check, bad_code: str, label: str | None = None) -> list[tuple[Column, str]]:
    x = at(v, name)
    label = label or name
    return [
        (~is_string(x), f"MISSING_FIELD:{label}"),
        (is_string(x) & (text(x) == ""), f"EMPTY_ID:{label}"),
        (is_string(x) & (text(x) != "") & ~check(text(x)), f"{bad_code}:{label}"),
    ]


def _required_text(x, label: str) -> list[tuple[Column, str]]:
    return [(~is_string(x), f"MISSING_FIELD:{label}"), (is_string(x) & (text(x) == ""), f"EMPTY_ID:{label}")]


def _optional_text(x, label: str) -> tuple[Column, str]:
    return (~absent(x) & ~is_string(x), f"INVALID_FIELD:{label}")


def _time_rules(x, label: str, required: bool) -> list[tuple[Column, str]]:
    wrong = ~absent(x) & ~(is_string(x) & F.coalesce(is_timestamp(text(x)), F.lit(False)))
    rules = [(wrong, f"INVALID_TIME:{label}")]
    return [(absent(x), f"MISSING_FIELD:{label}"), *rules] if required else rules


def _when(cond: Column, rules: list[tuple[Column, str]]) -> list[tuple[Column, str]]:
    return [(cond & F.coalesce(bad, F.lit(True)), code) for bad, code in rules]


def _payload_rules(v) -> tuple[list, list]:
    p = at(v, "payload")

    def f(name):
        return at(p, name)

    def of(kind, rules):
        return _when(one_of(at(v, "type"), (kind,)) & is_object(p), rules)

    def not_list(name, required=False):
        bad = ~string_list(f(name))
        return (bad | absent(f(name)) | (F.size(items(f(name))) == 0) if required else bad, f"INVALID_FIELD:payload.{name}")

    def each(name, rule, label):
        return (F.exists(items(f(name)), lambda i: ~F.coalesce(rule(i), F.lit(False))), f"INVALID_FIELD:payload.{name}.{label}")

    def good_id(x):
        return is_string(x) & F.coalesce(is_event_id(text(x)), F.lit(False))

    def optional_id(name):
        return (~absent(f(name)) & ~good_id(f(name)), f"INVALID_ID:{name}")

    def good_rank(i):
        r = at(i, "rank")
        return absent(r) | (is_integer(r) & (number(r) >= 1))

    value_ok = lambda i: ~absent(at(i, "value")) & (is_null(at(i, "value")) | is_string(at(i, "value")) | is_number(at(i, "value")))
    errors = [
        (~is_object(p), "INVALID_FIELD:payload"),
        *of("SEARCH", [
            *_required_text(f("query"), "payload.query"), (absent(f("results")), "MISSING_FIELD:payload.results"),
            (~absent(f("results")) & ~is_array(f("results")), "INVALID_FIELD:payload.results"),
            each("results", lambda i: is_object(i), "item"), each("results", lambda i: ~is_object(i) | good_id(at(i, "sourceId")), "sourceId"),
            each("results", good_rank, "rank"),
        ]),
        *of("READ", [*_id_rules(p, "sourceId", is_event_id, "INVALID_ID", "payload.sourceId"), (~one_of(f("outcome"), OPERATION_STATUSES), "INVALID_FIELD:payload.outcome"), _optional_text(f("summary"), "summary")]),
        *of("CLAIM", [*_required_text(f("text"), "payload.text"), optional_id("sourceId"), _optional_text(f("anchor"), "anchor")]),
        *of("COMPARE", [
            not_list("candidates", True), not_list("criteria", True), (~is_array(f("cells")), "INVALID_FIELD:payload.cells"),
            each("cells", lambda i: is_object(i), "item"),
            each("cells", lambda i: ~is_object(i) | (is_string(at(i, "candidate")) & (text(at(i, "candidate")) != "")), "candidate"),
            each("cells", lambda i: ~is_object(i) | (is_string(at(i, "criterion")) & (text(at(i, "criterion")) != "")), "criterion"),
            each("cells", lambda i: ~is_object(i) | value_ok(i), "value"),
            each("cells", lambda i: string_list(at(i, "evidenceEventIds")) & string_list(at(i, "sourceIds")), "ids"),
        ]),
        *of("HYPOTHESIS", [*_required_text(f("text"), "payload.text"), (~(is_null(f("basis")) | one_of(f("basis"), ("PUBLIC_STATEMENT", "LABELED_INFERENCE"))), "INVALID_FIELD:payload.basis"), not_list("basedOnEventIds")]),
        *of("CONTRADICTION", [*_required_text(f("description"), "payload.description"), not_list("conflictingEventIds", True), not_list("conditions")]),
        *of("VERIFY", [
            optional_id("targetEventId"), _optional_text(f("targetClaimText"), "targetClaimText"), *_required_text(f("method"), "payload.method"),
            (~one_of(f("result"), VERIFY_RESULTS), "INVALID_FIELD:payload.result"), not_list("evidenceEventIds"),
        ]),
        *of("RECOMMEND", [*_required_text(f("choice"), "payload.choice"), *[not_list(n) for n in ("alternatives", "userConditions", "rationale", "rationaleEventIds")]]),
    ]

    def names(x):
        return F.transform(items(x), text)

    unknown_cell = lambda n, pool: F.exists(items(f("cells")), lambda i: is_string(at(i, n)) & ~F.array_contains(names(f(pool)), text(at(i, n))))
    warnings = [
        *of("COMPARE", [(unknown_cell("candidate", "candidates") | unknown_cell("criterion", "criteria"), "CELL_TARGET_UNKNOWN")]),
        *of("CONTRADICTION", [(F.size(items(f("conflictingEventIds"))) == 1, "CONTRADICTION_SINGLE_REF")]),
        *of("VERIFY", [
            (absent(f("targetEventId")) & absent(f("targetClaimText")), "VERIFY_TARGET_UNSPECIFIED"),
            (F.size(items(f("evidenceEventIds"))) == 0, "VERIFY_WITHOUT_EVIDENCE"),
        ]),
    ]
    return errors, warnings


def validate_records(lines: DataFrame, prefix: str, body: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Trace records: valid rows (with ``v`` and ``body``), and a diagnostic row per finding.

    ``prefix`` is what the categories of the traces begin with, such as ``TRACE_``.

    Diagnostics: the columns of the line, code, severity, field. Errors reject, the rest does not.
    """
    keep = [c for c in lines.columns if c != body]
    v = Doc("v", {"event": EVENT_FIELDS, "run": RUN_FIELDS, "answer": ANSWER_FIELDS})
    kind, version = at(v, "recordKind"), at(v, "schemaVersion")
    is_kind = one_of(kind, ("event", "run", "answer"))
    event, run, answer = (one_of(kind, (k,)) for k in ("event", "run", "answer"))
    head = [
        (~is_integer(version), "INVALID_SCHEMA_VERSION:schemaVersion"),
        (is_integer(version) & (number(version) > SCHEMA_VERSION), "FUTURE_SCHEMA_VERSION:schemaVersion"),
        (is_integer(version) & (number(version) < SCHEMA_VERSION), "UNSUPPORTED_SCHEMA_VERSION:schemaVersion"),
        (~is_kind, "INVALID_FIELD:recordKind"),
    ]
    seq = at(v, "sequence")
    envelope = _when(is_kind, [
        *_id_rules(v, "runId", is_run_id, "INVALID_RUN_ID"),
        *_time_rules(at(v, "occurredAt"), "occurredAt", True),
        *_time_rules(at(v, "receivedAt"), "receivedAt", False),
        (~absent(seq) & ~(is_integer(seq) & (number(seq) >= 0)), "INVALID_SEQUENCE:sequence"),
        *_id_rules(v, "adapterId", is_event_id, "INVALID_ID"),
        *_required_text(at(v, "adapterVersion"), "adapterVersion"),
    ])
    prov, origin, source, rels = at(v, "provenance"), at(v, "origin"), at(v, "source"), at(v, "relations")
    named = text(at(prov, "category"))
    category = F.coalesce(F.when(named.isin(*[prefix + c for c in ("REPORTED", "OBSERVED", "INFERRED")]), F.substring(named, len(prefix) + 1, 8)), F.lit(""))
    observed, inferred = at(prov, "observed"), at(prov, "inferred")
    locators = [at(observed, n) for n in ("file", "recordId", "toolCallId", "toolResultId")]
    located = F.lit(False)
    for x in locators:
        located = located | is_string(x)
    for x in (at(observed, "line"), at(observed, "byteOffset")):
        located = located | is_integer(x)
    payload_errors, payload_warnings = _payload_rules(v)

    def bad_relation(i):
        target, other = at(i, "targetEventId"), at(i, "targetRunId")
        good = (
            is_object(i) & one_of(at(i, "type"), RELATION_TYPES) & is_string(target) & F.coalesce(is_event_id(text(target)), F.lit(False))
            & (absent(other) | (is_string(other) & F.coalesce(is_run_id(text(other)), F.lit(False))))
        )
        return ~good

    of_event = [
        *_id_rules(v, "eventId", is_event_id, "INVALID_ID"),
        (~one_of(at(v, "type"), DOMAIN_TYPES), "INVALID_FIELD:type"),
        (~is_object(prov), "INVALID_FIELD:provenance"),
        (is_object(prov) & F.coalesce(category == "", F.lit(True)), "INVALID_FIELD:provenance.category"),
        (~absent(observed) & ~is_object(observed), "INVALID_FIELD:provenance.observed"),
        (~absent(inferred) & ~is_object(inferred), "INVALID_FIELD:provenance.inferred"),
        (~string_list(at(inferred, "inputEventIds")), "INVALID_FIELD:inputEventIds"),
        *[_optional_text(x, "provenance.observed") for x in locators],
        (~is_object(origin), "INVALID_FIELD:origin"),
        *_when(is_object(origin), [*_required_text(at(origin, "producer"), "origin.producer"), *[_optional_text(at(origin, n), f"origin.{n}") for n in ("agent", "tool", "recordedFrom")]]),
        (~is_object(source), "INVALID_FIELD:source"),
        *_when(is_object(source), [
            *_id_rules(source, "sourceId", is_event_id, "INVALID_ID", "source.sourceId"), (~one_of(at(source, "kind"), SOURCE_KINDS), "INVALID_FIELD:source.kind"),
            *[_optional_text(at(source, n), f"source.{n}") for n in ("location", "anchor", "contentHash", "title")],
            *_time_rules(at(source, "accessedAt"), "accessedAt", False),
        ]),
        (~absent(rels) & ~is_array(rels), "INVALID_FIELD:relations"),
        (F.exists(items(rels), bad_relation), "INVALID_FIELD:relations.item"),
        *payload_errors,
    ]
    of_run = [(~one_of(at(v, "lifecycle"), LIFECYCLES), "INVALID_FIELD:lifecycle"), _optional_text(at(v, "detail"), "detail")]
    of_answer = _receipt_rules(v)
    size = [(F.octet_length("body") > MAX_RECORD_BYTES, "OVERSIZED_RECORD:record")]
    place = ~absent(at(source, "sourceId")) & absent(at(source, "location")) & ~one_of(at(source, "kind"), ("UNKNOWN", "TOOL_RESULT"))
    warn = [
        (is_object(source) & place, "SOURCE_LOCATION_MISSING"),
        ((category == "OBSERVED") & ~located, "OBSERVED_WITHOUT_LOCATION"),
        ((category == "INFERRED") & (F.size(items(at(inferred, "inputEventIds"))) == 0), "INFERRED_WITHOUT_INPUTS"),
        *payload_warnings,
    ]
    known = F.when(event, F.array(*map(F.lit, EVENT_FIELDS))).when(run, F.array(*map(F.lit, RUN_FIELDS))).otherwise(F.array(*map(F.lit, ANSWER_FIELDS)))
    info = [
        (is_kind & (F.size(F.array_except(keys(v), known)) > 0), "UNKNOWN_FIELD_DROPPED"),
        (F.size("removed") > 0, "REDACTED_PRIVATE_FIELD"),
    ]
    none = F.array().cast("array<string>")
    own = F.when(event, _broken(of_event)).when(run, _broken(of_run)).when(answer, _broken(of_answer)).otherwise(none)
    errors = F.when(~is_object(v), F.array(F.lit("INVALID_RECORD:record"))).otherwise(F.concat(_broken(head + envelope), own, _broken(size)))
    stripped = spread(lines).withColumn("_s", strip_private(F.col(body))).select(*keep, F.col("_s.body").alias("body"), F.col("_s.removed").alias("removed"))
    rows = v.attach(stripped.withColumn("v", parse_strict(F.col("body"))))
    # Written once: records and notes both read the findings, and a filter or a generator on them would work out the rules again.
    checked = stage(rows.select(*keep, "v", "body", errors.alias("_e"), F.when(event, _broken(warn)).alias("_w"), F.when(is_object(v), _broken(info)).alias("_i")))

    def tagged(name, severity):
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda c: F.struct(
            F.substring_index(c, ":", 1).alias("code"), F.lit(severity).alias("severity"), F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", -1)).alias("field")))

    notes = checked.select(*keep, F.inline(F.concat(tagged(F.col("_e"), "error"), tagged(F.col("_w"), "warning"), tagged(F.col("_i"), "info"))))
    return checked.where(F.size("_e") == 0).select(*keep, "v", "body"), notes.dropDuplicates()


def _receipt_rules(v) -> list[tuple[Column, str]]:
    own, shared = at(v, "eventIds"), at(v, "sharedEventIds")
    question, declared = at(v, "questionSummary"), at(v, "answerHash")

    def bad_scope(x):
        ids = F.transform(items(x), text)
        return is_array(x) & (
            (F.size(ids) > 10_000) | ~F.forall(ids, lambda i: F.coalesce(is_event_id(i), F.lit(False))) | (F.size(F.array_distinct(ids)) != F.size(ids))
        )

    rules = []
    for name in ("receiptId", "answerId", "agentId"):
        rules += _id_rules(v, name, is_event_id, "INVALID_ID")
    for name in ("agentSessionId", "turnId"):
        rules += _when(~absent(at(v, name)), _id_rules(v, name, is_event_id, "INVALID_ID"))
    return [
        *rules,
        *_required_text(at(v, "answer"), "answer"),
        *_time_rules(at(v, "timestamp"), "timestamp", True),
        _optional_text(question, "questionSummary"),
        (is_string(question) & (F.length(text(question)) > 500), "INVALID_FIELD:questionSummary"),
        (~(is_integer(at(v, "receiptVersion")) & (number(at(v, "receiptVersion")) == 1)), "INVALID_RECEIPT_VERSION:receiptVersion"),
        (~(is_bool(at(v, "final")) & F.try_variant_get(at(v, "final").v, "$", "boolean")), "ANSWER_NOT_FINAL:final"),
        (~absent(at(v, "hashVersion")) & ~one_of(at(v, "hashVersion"), ("sha256-sanitized-nfc-lf-v1",)), "INVALID_HASH_VERSION:hashVersion"),
        (~string_list(own), "INVALID_FIELD:eventIds"),
        (~string_list(shared), "INVALID_FIELD:sharedEventIds"),
        (bad_scope(own) | bad_scope(shared), "INVALID_SCOPE:scope"),
        (F.arrays_overlap(F.transform(items(own), text), F.transform(items(shared), text)), "INVALID_SCOPE:disjoint"),
        (~absent(declared) & ~(is_string(declared) & (text(declared) == answer_hash(F.when(is_string(declared), text(at(v, "answer")))))), "ANSWER_HASH_MISMATCH:answerHash"),
    ]
