"""Schemas and closed vocabularies shared by sources and operators."""

from __future__ import annotations

SESSION_EVENT = (
    "id string, session_id string, parent_id string, agent_id string, parent_agent_id string, type string, "
    "ts_ms bigint, input_index bigint, duration_ms double, source string, summary string, "
    "meta_role string, meta_task string, meta_cwd string, meta_outcome string, meta_status string, "
    "meta_tests_failed double, meta_additions double, meta_deletions double, file_path string, command string, "
    "tool_name string, status string, error string, exit_code int"
)
# The closed vocabularies.
EVENT_TYPES = (
    "SESSION_STARTED", "SESSION_COMPLETED", "AGENT_STARTED", "AGENT_COMPLETED", "SUBAGENT_STARTED",
    "SUBAGENT_COMPLETED", "MESSAGE", "TOOL_CALLED", "TOOL_RESULT", "FILE_READ", "FILE_CREATED", "FILE_CHANGED",
    "FILE_DELETED", "COMMAND_STARTED", "COMMAND_COMPLETED", "TEST_STARTED", "TEST_PASSED", "TEST_FAILED",
    "BUILD_STARTED", "BUILD_PASSED", "BUILD_FAILED", "ERROR", "CHECKPOINT",
)
EVENT_STATUSES = ("ok", "error", "running", "aborted", "timeout", "unknown")

REPLAY_EVENT = (
    "session_id string, source string, seq bigint, event_type string, ts_offset bigint, tool_name string, ok boolean, "
    "verification_kind string, changed_files int, change_hash string, fingerprint_basis string, failure_sig string, "
    "tests_failed int, duration_ms double, turn bigint, test_only boolean, path string"
)
ATTEMPT_EVIDENCE = (
    "series_id string, idx bigint, attempt_id string, build_status string, tests_failed int, crash_sig string, "
    "screen_sig string, verified boolean, changed_files int, change_hash string"
)
