"""Reading commands, tool output and patches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import let

# What counts as a test, device or build command, in this order.
_SCRIPT_TEST = r"(?:npm|pnpm|yarn|bun)(?:\s+run)?\s+(?:test|tests|spec|e2e|unit)(?::[\w:.-]+)?\b"
_SCRIPT_BUILD = (
    r"(?:npm|pnpm|yarn|bun)(?:\s+run)?\s+(?:build|typecheck|type-check|tsc|compile|check|verify|ci)(?::[\w:.-]+)?\b"
)
TEST_COMMAND = (
    rf"(?i)\b({_SCRIPT_TEST}|jest\b|vitest\b|pytest\b|node --test\b|playwright\b|go test\b|cargo test\b"
    r"|gradlew?(?:\.bat)?\b[^|;&]*\btest\b|mvn\b[^|;&]*\btest\b|dotnet test\b)"
)
DEVICE_COMMAND = r"(?i)\b(adb(?:\.exe)?\s|agent-device\s|emulator\s|maestro\s|xcrun\s)"
BUILD_COMMAND = (
    rf"(?i)\b({_SCRIPT_BUILD}|gradlew?(?:\.bat)?\s|gradle\s|mvn\s|make\b|cmake\b|tsc\b|go build\b|dotnet build\b"
    r"|cargo build\b)"
)
MOBILE_COMMAND = (
    r"(?i)\b(adb(?:\.exe)?\s|gradlew?(?:\.bat)?\b|emulator\b|agent-device\s|logcat\b|\.apk\b|aapt\d?\s|android\b"
    r"|com\.android\.\w+)"
)
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|spec)(/|$)|\.(test|spec)\.[a-z]+$"


def classify_verification(command: Column) -> Column:
    return (
        F.when(command.rlike(TEST_COMMAND), "test")
        .when(command.rlike(DEVICE_COMMAND), "device")
        .when(command.rlike(BUILD_COMMAND), "build")
    )


def is_mobile_command(command: Column) -> Column:
    return command.rlike(MOBILE_COMMAND)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def only_test_paths(paths: Column) -> Column:
    return (F.size(paths) > 0) & F.forall(paths, is_test_path)


# Failure counts, first hit wins.
FAILED_COUNTS = (
    r"(?i)(\d+)\s+/\s*\d+\s+tests?\s+failed",
    r"(?i)(\d+)\s+(?:tests?|specs?|examples?)\s+failed",
    r"(?i)(\d+)\s+failing\b",
    r"(?i)Tests?:\s*(\d+)\s*failed",
)


def extract_failed_count(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int") for p in FAILED_COUNTS])


def exit_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)exit code[:\s]+(\d+)", 1), F.lit("")).try_cast("int")


# Masks applied in order, and harness lines that carry no identity.
SIGNATURE_MASKS = (
    (r"""[A-Za-z]:\\[^\s"']+""", "<PATH>"),
    (r"(?:/(?:home|Users|root|tmp|var|mnt)/\S+)", "<PATH>"),
    (r"(?i)\b[0-9a-f]{8,}\b", "<HEX>"),
    (r"\b\d+(?:\.\d+)?\b", "<N>"),
)
GENERIC_LINE = (
    r"(?i)^(?:(?:script|command|shell|exec(?:ution)?)\s+(?:failed|completed|error)?\s*[:]?"
    r"|wall time:? <N>(?: seconds)?|output:?|exit code[:\s]*<N>|process exited(?: with code <N>)?"
    r"|failed|error|<N>)\s*$"
)


def failure_signature(text: Column) -> Column:
    """Eight hex digits that stay the same when only numbers, hashes or paths differ."""
    for pattern, mask in SIGNATURE_MASKS:
        text = F.regexp_replace(text, pattern, mask)
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    content = F.filter(lines, lambda x: (F.length(x) > 3) & ~x.rlike(GENERIC_LINE))

    def digest(c: Column) -> Column:
        tail = F.array_join(F.slice(c, F.greatest(F.size(c) - 2, F.lit(1)), F.lit(3)), "\n")
        return F.substring(F.sha2(F.when(F.size(c) == 0, F.lit("<opaque-failure>")).otherwise(tail), 256), 1, 8)

    return let(content, digest)


def display_path(path: Column, cwd: Column | None = None) -> Column:
    """Slashes forward, drive dropped, relative to the working folder, at most four segments."""
    p = F.regexp_replace(F.regexp_replace(path, r"[\\]+", "/"), "^[A-Za-z]:/", "")
    if cwd is not None:
        base = F.regexp_replace(F.regexp_replace(cwd, r"[\\]+", "/"), "^[A-Za-z]:/", "")
        base = F.coalesce(F.regexp_replace(base, "/+$", ""), F.lit(""))
        inside = (F.length(base) > 0) & F.startswith(F.lower(p), F.concat(F.lower(base), F.lit("/")))
        p = F.when(inside, F.substring(p, F.length(base) + 2, F.length(p))).otherwise(p)
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    n = F.size(parts)
    return F.when(n > 4, F.concat(F.lit("…/"), F.array_join(F.slice(parts, n - 3, F.lit(4)), "/"))).otherwise(
        F.array_join(parts, "/")
    )


def unescape_patch(text: Column) -> Column:
    """A patch held inside a quoted string has its line ends escaped; bring them back."""
    return F.when(
        F.contains(text, F.lit("\n")), text
    ).otherwise(F.regexp_replace(text, r"\\n", "\n"))


def patch_files(patch: Column) -> Column:
    """``array<struct<op,path>>`` of the file headers of a patch."""
    heads = F.regexp_extract_all(patch, F.lit(r"(?m)^\s*\*\*\* ((?:Add|Update|Delete) File: [^\r\n]+)$"), F.lit(1))
    return F.transform(
        heads,
        lambda h: F.struct(
            F.lower(F.substring_index(h, " File: ", 1)).alias("op"),
            F.trim(F.regexp_replace(h, r"^\w+ File: |\s+$", "")).alias("path"),
        ),
    )


def embedded_command(program: Column) -> Column:
    """First inner shell call of a program whose quoted strings read as a verification command.

    A window is the 400 characters from the call on, so windows may overlap: the call positions are
    found first and each window is cut from the program.
    """
    marker = r"tools\.(?:exec_command|shell_command)\("
    pieces = F.split(program, f"(?={marker})")
    # Character offset of each piece = total length of the pieces before it.
    ends = F.aggregate(
        pieces,
        F.array(F.lit(1)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))),
    )
    starts = F.filter(
        F.transform(pieces, lambda p, i: F.struct(F.get(ends, i).alias("at"), p.rlike(f"^{marker}").alias("hit"))),
        lambda s: s["hit"],
    )
    windows = F.transform(starts, lambda s: F.substring(program, s["at"], F.lit(400)))

    def joined(w):
        strings = F.regexp_extract_all(w, F.lit(r'"((?:\\.|[^"\\]){0,200}?)"'), F.lit(1))
        cleaned = F.transform(strings, lambda s: F.trim(F.regexp_replace(s, r"\\n", " ")))
        return F.array_join(F.filter(cleaned, lambda s: s != ""), " ")

    calls = F.transform(
        windows, lambda w: F.struct(classify_verification(joined(w)).alias("kind"), joined(w).alias("command"))
    )
    return F.get(F.filter(calls, lambda c: c["kind"].isNotNull()), 0)
