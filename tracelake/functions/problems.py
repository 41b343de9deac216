"""Failure taxonomy over the columns of a session event."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ellipsis, first_line

# Error identities that point outside the work itself, tried in this order.
PROVIDER_DETAILS = (
    ("QUOTA", r"(?i)\b402\b|quota\s*(exceeded|exhausted)|insufficient_quota|credit.{0,20}(exceeded| exhausted)|billing"),
    ("AUTH", r"(?i)\b40[13]\b|unauthorized|forbidden|invalid[_\s]api[_\s]?key|authentication"),
    ("RATE_LIMIT", r"(?i)\b429\b|rate[_\s]?limit|too\s+many\s+requests"),
)
ENVIRONMENT = (
    r"(?i)timeout|timed\s*out|ECONNRESET|ECONNREFUSED|ENOTFOUND|EPIPE|socket\s+hang\s+up"
    r"|network\s+(error|unreachable)|DNS"
)
PROVIDER_OTHER = r"(?i)\bAPI\b|overloaded|internal\s+server\s+error|\b5\d\d\b"
PROVIDER_LABELS = {"QUOTA": "quota exceeded", "AUTH": "authentication failed", "RATE_LIMIT": "rate limited"}
AGENT_END = ("AGENT_COMPLETED", "SUBAGENT_COMPLETED")
AGENT_START = ("AGENT_STARTED", "SUBAGENT_STARTED")
WRITES = ("FILE_CREATED", "FILE_CHANGED", "FILE_DELETED")


def _col(name: str) -> Column:
    return F.col(name)


def is_failure() -> Column:
    t, status = _col("type"), _col("status")
    bad = status.isin("error", "timeout", "aborted")
    return F.coalesce(
        F.when(t.isin("TEST_FAILED", "BUILD_FAILED", "ERROR"), True)
        .when(t == "COMMAND_COMPLETED", F.coalesce(_col("exit_code") != 0, F.lit(False)) | F.coalesce(bad, F.lit(False)))
        .when(t == "TOOL_RESULT", status == "error")
        .when(t.isin(*AGENT_END), bad),
        F.lit(False),
    )


def problem_kind() -> Column:
    t, status = _col("type"), _col("status")
    return (
        F.when(t == "TEST_FAILED", "test-failure")
        .when(t == "BUILD_FAILED", "build-failure")
        .when(
            t == "COMMAND_COMPLETED",
            F.when(status == "timeout", "timeout").when(status == "aborted", "abort").otherwise("command-failure"),
        )
        .when(t.isin(*AGENT_END), "agent-failure")
        .otherwise("error")
    )


def classify_problem(kind: Column, identity: Column) -> Column:
    """``struct<category,detail>`` from the kind and the first line of the error."""
    text = F.coalesce(identity, F.lit(""))
    open_ended = ~kind.isin("test-failure", "build-failure", "command-failure", "timeout", "abort")
    detail = F.when(F.lit(False), "")
    for name, pattern in PROVIDER_DETAILS:
        detail = detail.when(text.rlike(pattern), name)
    category = (
        F.when(kind.isin("test-failure", "build-failure"), "VALIDATION")
        .when(~open_ended, "TOOL")
        .when(detail.isNotNull(), "PROVIDER")
        .when(text.rlike(ENVIRONMENT), "ENVIRONMENT")
        .when(text.rlike(PROVIDER_OTHER), "PROVIDER")
        .when(kind == "agent-failure", "UNKNOWN")
        .otherwise("CODE")
    )
    return F.struct(category.alias("category"), F.when(open_ended, detail).alias("detail"))


def failure_description() -> Column:
    t, cmd, tool = _col("type"), _col("command"), _col("tool_name")
    n = _col("meta_tests_failed")
    count = F.when(
        n.isNotNull(),
        F.concat(F.format_string("%.0f", n), F.when(n == 1, " test failed").otherwise(" tests failed")),
    ).otherwise("tests failed")
    return (
        F.when(t == "TEST_FAILED", F.concat(F.coalesce(cmd, F.lit("test run")), F.lit(" — "), count))
        .when(t == "BUILD_FAILED", F.concat(F.coalesce(cmd, tool, F.lit("build")), F.lit(" — build failed")))
        .when(
            t == "COMMAND_COMPLETED",
            F.concat(
                F.coalesce(cmd, tool, F.lit("command")),
                F.lit(" failed"),
                F.coalesce(F.concat(F.lit(" (exit code "), _col("exit_code").cast("string"), F.lit(")")), F.lit("")),
            ),
        )
        .when(t.isin(*AGENT_END), F.concat(_col("agent_id"), F.lit(" failed")))
        .when(t == "TOOL_RESULT", F.concat(F.coalesce(tool, F.lit("tool")), F.lit(" call reported an error")))
        .otherwise(
            F.coalesce(F.concat(F.coalesce(cmd, tool, _col("file_path")), F.lit(" — error")), F.lit("error reported"))
        )
    )


def external_description(category: Column, detail: Column) -> Column:
    label = F.when(F.lit(False), "")
    for name, text in PROVIDER_LABELS.items():
        label = label.when(detail == name, text)
    return F.when(
        category == "PROVIDER", F.concat(F.lit("Provider issue — "), label.otherwise("provider error"))
    ).otherwise(F.lit("Environment issue — transport/network failure"))


def command_ok() -> Column:
    return (_col("type") == "COMMAND_COMPLETED") & (
        F.coalesce(_col("exit_code") == 0, F.lit(False)) | F.coalesce(_col("status") == "ok", F.lit(False))
    )


def positive_for(kind: Column) -> Column:
    """Whether this row proves recovery of a failure of ``kind``; commands must match apart."""
    t = _col("type")
    return (
        F.when(kind == "test-failure", t == "TEST_PASSED")
        .when(kind == "build-failure", t == "BUILD_PASSED")
        .when(kind.isin("command-failure", "timeout", "abort"), command_ok() & _col("command").isNotNull())
        .when(kind == "error", t.isin("TEST_PASSED", "BUILD_PASSED") | command_ok())
        .otherwise(F.lit(False))
    )


def signal_description() -> Column:
    t = _col("type")
    return (
        F.when(t == "TEST_PASSED", "tests passed")
        .when(t == "BUILD_PASSED", "build passed")
        .when(t == "SESSION_COMPLETED", "session completed successfully afterwards")
        .when(t.isin(*AGENT_START), F.concat(F.lit("reassigned to "), F.coalesce(_col("agent_id"), F.lit("another agent"))))
        .otherwise(F.concat(F.coalesce(_col("command"), F.lit("command")), F.lit(" succeeded")))
    )


def follow_up_description() -> Column:
    t = _col("type")
    file = F.coalesce(_col("file_path"), F.lit("file"))
    return (
        F.when(t == "FILE_CREATED", F.concat(file, F.lit(" created")))
        .when(t == "FILE_DELETED", F.concat(file, F.lit(" deleted")))
        .when(t == "FILE_CHANGED", F.concat(file, F.lit(" changed")))
        .when(t == "FILE_READ", F.concat(F.lit("inspected "), file))
        .otherwise(
            F.concat(
                F.lit("ran "),
                F.when(_col("command").isNotNull(), F.coalesce(first_line(_col("command"), 80), F.lit("null"))).otherwise(
                    F.coalesce(_col("tool_name"), F.lit("verification"))
                ),
            )
        )
    )


def last_observed_text() -> Column:
    """Label of one event for the last-observed line; null for types that are not humanized."""
    t = _col("type")

    def cut(c):
        return ellipsis(F.trim(F.regexp_replace(c, r"\s+", " ")), 60)

    file = cut(F.coalesce(_col("file_path"), F.lit("a file")))
    return (
        F.when(t == "TEST_PASSED", "tests passed")
        .when(t == "TEST_FAILED", "tests failed")
        .when(t == "BUILD_PASSED", "build passed")
        .when(t == "BUILD_FAILED", "build failed")
        .when(
            t.isin("COMMAND_STARTED", "COMMAND_COMPLETED"),
            F.concat(F.lit("ran "), cut(F.coalesce(_col("command"), _col("tool_name"), F.lit("a command")))),
        )
        .when(t == "FILE_CHANGED", F.concat(F.lit("modified "), file))
        .when(t == "FILE_CREATED", F.concat(F.lit("created "), file))
        .when(t == "FILE_DELETED", F.concat(F.lit("deleted "), file))
        .when(t == "FILE_READ", F.concat(F.lit("read "), file))
        .when(t.isin("TEST_STARTED", "BUILD_STARTED"), F.coalesce(cut(_col("summary")), F.lit("activity")))
    )
