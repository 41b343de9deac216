"""Conditions such as ``region=EU`` or ``year: 2024``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tokens per dimension, tried in this order.
DIMENSION_TOKENS = (
    ("TIME", ("TIME", "DATE", "YEAR", "PERIOD")),
    ("REGION", ("REGION", "COUNTRY", "LOC", "GEO")),
    ("VERSION", ("VERSION", "VER")),
    ("ENVIRONMENT", ("ENV", "OS", "PLATFORM")),
    ("USER_REQUIREMENT", ("USER", "REQ")),
    ("POPULATION", ("POP", "SAMPLE")),
    ("SUBJECT", ("SUBJ", "TARGET")),
)
PREFIXES = (
    ("TIME", ("time:", "year:", "date:")),
    ("ENVIRONMENT", ("env:", "os:")),
    ("VERSION", ("ver:", "version:")),
    ("REGION", ("region:", "geo:")),
    ("USER_REQUIREMENT", ("user:", "req:")),
)
_PATTERN = r"(?i)^([a-zA-Z_-]+)\s*(==|=|!=|>=|<=|>|<|in|before|after|at)\s*(.+)$"


def parse_condition(raw: Column) -> Column:
    """``struct<id,dimension,op,value,key>`` of a condition text."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    name = F.regexp_extract(text, _PATTERN, 1)
    op = F.lower(F.regexp_extract(text, _PATTERN, 2))
    rest = F.regexp_replace(F.regexp_extract(text, _PATTERN, 3), r"^\s+|\s+$", "")
    matched = name != ""
    upper = F.upper(name)

    dimension = F.when(F.lit(False), "")
    for label, tokens in DIMENSION_TOKENS:
        dimension = dimension.when(matched & upper.rlike("|".join(tokens)), label)
    prefixed = F.lit(False)
    lower = F.lower(text)
    for label, prefixes in PREFIXES:
        hit = lower.rlike("^(?:" + "|".join(prefixes) + ")")
        dimension = dimension.when(~matched & hit, label)
        prefixed = prefixed | hit
    dimension = dimension.otherwise("OTHER")
    prefixed = prefixed & ~matched

    operator = (
        F.when(~matched | op.isin("=", "=="), "EQ")
        .when(op == "!=", "NEQ")
        .when(op == "in", "IN")
        .when(op.isin("before", "<", "<="), "BEFORE")
        .when(op.isin("after", ">", ">="), "AFTER")
        .otherwise("AT")
    )
    value = F.when(matched, rest).when(prefixed, F.regexp_replace(text, r"^[^:]+:\s*", "")).otherwise(text)
    key = F.when(
        (dimension == "OTHER") & matched, F.concat(F.lit("other:"), F.lower(name))
    ).otherwise(F.lower(dimension))
    digest = F.substring(F.sha2(F.concat_ws(":", key, operator, value), 256), 1, 12)
    ident = F.concat(F.lit("cond-"), F.regexp_replace(key, "[^a-z0-9-]", "-"), F.lit("-"), digest)
    return F.struct(
        ident.alias("id"), dimension.alias("dimension"), operator.alias("op"), value.alias("value"), key.alias("key")
    )
