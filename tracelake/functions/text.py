"""Text clean-up, redaction and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ellipsis(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def first_line(c: Column, limit: int = 160, strip_markup: bool = False) -> Column:
    """First non-blank line, trimmed and cut; null when there is none.

    With ``strip_markup`` terminal colour codes and tags go first and the result is never null.
    """
    if strip_markup:
        text = F.regexp_replace(F.regexp_replace(c, "\x1b\\[[0-9;]*[A-Za-z]", ""), "<[^>]+>", "")
    else:
        text = F.regexp_replace(c, r"[\\]+", "/")
    line = F.regexp_replace(F.regexp_extract(text, r"(\S[^\n]*)", 1), r"\s+$", "")
    line = ellipsis(line, limit)
    return line if strip_markup else F.nullif(line, F.lit(""))


# The four redaction rules and their replacements.
REDACTIONS = (
    (r"\b(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{16,})\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{8,}", "Bearer [REDACTED]"),
    (
        r"""(?i)((?:api[_-]?key|access[_-]?token|refresh[_-]?token|token|password|secret|authorization)\s*[=:]\s*["']?)[^\s&"'<>]+""",
        "$1[REDACTED]",
    ),
    (r"(?i)(https?://)[^\s/@]+:[^\s/@]+@", "$1[REDACTED]@"),
)


def redact_secrets(c: Column) -> Column:
    for pattern, replacement in REDACTIONS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


# Terminal escape sequences and control characters.
ANSI = "(?:\x1b\\[|\u009b)[0-9;?]*[ -/]*[@-~]|(?:\x1b\\]|\u009d)[^\x07\x1b\u009c]*(?:\x07|\x1b\\\\|\u009c)?"
CONTROLS = "[\\x00-\\x08\\x0b-\\x1f\\x7f\u0080-\u009f]"


def sanitize_text(c: Column, limit: int = 200) -> Column:
    """Text safe for a terminal: no escapes, no controls, one line, cut with an ellipsis."""
    c = squeeze(F.regexp_replace(F.regexp_replace(c, ANSI, " "), CONTROLS, " "))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def activity_snippet(p: Column) -> Column:
    """One line on a payload: type, query, results, source_id, outcome, text, candidates, cells, description, method, result, choice."""
    def joined(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    return (
        F.when(p["type"] == "SEARCH", joined('"', sanitize_text(p["query"], 120), '" · ', p["results"].cast("string"), " result(s)"))
        .when(p["type"] == "READ", joined(p["source_id"], " · ", p["outcome"]))
        .when(p["type"].isin("CLAIM", "HYPOTHESIS"), sanitize_text(p["text"], 140))
        .when(p["type"] == "COMPARE", joined(F.array_join(p["candidates"], " vs "), " · ", p["cells"].cast("string"), " cells"))
        .when(p["type"] == "CONTRADICTION", sanitize_text(p["description"], 140))
        .when(p["type"] == "VERIFY", joined(sanitize_text(p["method"], 80), " → ", p["result"]))
        .when(p["type"] == "RECOMMEND", joined("→ ", sanitize_text(p["choice"], 120)))
    )


def sanitize_signature(c: Column, limit: int = 120) -> Column:
    return F.substring(squeeze(F.regexp_replace(c, r"[\x00-\x1f\x7f]+", " ")), 1, limit)


# Openings that mark a text as put in by the harness.
HARNESS = (
    r"^you are running inside\b",
    r"^working directory\b",
    r"^the following is the\b",
    r"^set model to\b",
    r"^<[^>]+>",
    r"^/[a-z]",
    r"^# ",
)


def is_harness_text(c: Column) -> Column:
    return F.trim(c).rlike("(?i)" + "|".join(f"(?:{p})" for p in HARNESS))


def clean_label(c: Column, limit: int = 48) -> Column:
    """Drop shell transport prefixes from a last-observed label; null when nothing is left."""
    for pattern, replacement in (
        (r"""(?i)cd\s+(?:"[^"]*"|'[^']*'|[^\s&]+)\s*&&\s*""", ""),
        (r"(?i)Set-Location\s+-LiteralPath\s+'[^']*'\s*;?\s*", ""),
        (r"(?i)\$ProgressPreference\s*=\s*'[^']*';\s*", ""),
        (r"(?i)^ran\s+", "ran "),
    ):
        c = F.regexp_replace(c, pattern, replacement)
    return F.nullif(ellipsis(squeeze(c), limit), F.lit(""))


def is_task_shaped(c: Column) -> Column:
    return ~F.substring(c, 1, 1).isin("<", "/", "#")


def short_task(c: Column) -> Column:
    return ellipsis(c, 120)


def duration_label(ms: Column) -> Column:
    """Clock style: ``1h 02m``, ``3m 04s``, ``5s``; a dash when unknown."""
    s = F.floor(ms / 1000 + 0.5).cast("bigint")
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(ms.isNull(), "—")
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), F.lpad(m.cast("string"), 2, "0"), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), F.lpad(sec.cast("string"), 2, "0"), F.lit("s")))
        .otherwise(F.concat(sec.cast("string"), F.lit("s")))
    )


def duration_words(ms: Column) -> Column:
    """Report style: seconds below a minute, minutes below 90, hours below two days, then days."""
    minutes = ms / 60_000
    hours = F.floor(minutes / 60)

    def rounded(x):
        return F.floor(x + 0.5).cast("bigint").cast("string")

    return (
        F.when(ms.isNull() | (ms <= 0), "n/a")
        .when(minutes < 1, F.concat(rounded(ms / 1000), F.lit(" s")))
        .when(minutes < 90, F.concat(rounded(minutes), F.lit(" min")))
        .when(hours < 48, F.concat(hours.cast("string"), F.lit(" h "), rounded(minutes - hours * 60), F.lit(" min")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d "), (hours % 24).cast("string"), F.lit(" h*")))
    )


# Question words per mode, tried in this order.
QUESTION_MODES = (
    ("COMPARE", r"\b(vs|compare|comparison|difference|differences|versus)\b"),
    ("DECIDE", r"\b(recommend|recommendation|should i choose|best choice|which one|pick)\b"),
    ("VERIFY", r"\b(verify|is it true|fact check|factcheck|check if|validate|true or false)\b"),
    ("ASSESS", r"\b(risk|risks|assess|assessment|feasibility|freshness|security posture)\b"),
    ("IDEATE", r"\b(brainstorm|ideas|alternatives|options|ideate|explore variants)\b"),
    ("EXPLAIN", r"\b(why|how does|explain|architecture|mechanism|cause)\b"),
)
ASSESSMENT_WORDS = r"\b(risk|assess|assessment|posture|freshness|vulnerability|vulnerabilities|benchmark)\b"


def infer_mode(question: Column) -> Column:
    q = F.lower(question)
    mode = F.when(question.isNull(), "UNKNOWN")
    for name, pattern in QUESTION_MODES:
        mode = mode.when(q.rlike(pattern), name)
    return mode.otherwise("UNKNOWN")


def outcome_runs(outcomes: Column) -> Column:
    """Run-length label of a list of pass/fail flags: ``FAIL ×2 → edit → PASS``."""
    size = F.size(outcomes)
    starts = F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(outcomes, i) != F.get(outcomes, i - 1))
    )
    label = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.size(starts) - 1),
            lambda j: F.concat(
                F.when(F.get(outcomes, F.get(starts, j)), "PASS").otherwise("FAIL"),
                F.when(
                    F.coalesce(F.get(starts, j + 1), size) - F.get(starts, j) > 1,
                    F.concat(F.lit(" ×"), (F.coalesce(F.get(starts, j + 1), size) - F.get(starts, j)).cast("string")),
                ).otherwise(""),
            ),
        ),
        " → edit → ",
    )
    return F.when(outcomes.isNull() | (size <= 0), "—").otherwise(label)
