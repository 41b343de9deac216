"""Identities: canonical JSON, content hashes, keyed fingerprints, set hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .text import redact_secrets


def lf(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def canonical_json(c: Column) -> Column:
    """JSON text with keys sorted at every depth (Spark writes variant objects in key order)."""
    return F.to_json(F.try_parse_json(c))


def content_hash(record: Column) -> Column:
    """Hash of a JSON record without the reception stamps ``sequence`` and ``receivedAt``."""
    fields = F.try_parse_json(record).cast("map<string,variant>")
    kept = F.map_filter(fields, lambda k, v: ~k.isin("sequence", "receivedAt"))
    return F.sha2(F.to_json(F.to_variant_object(kept)), 256)


def record_hash(record: Column) -> Column:
    return F.sha2(canonical_json(record), 256)


@F.pandas_udf(T.StringType())
def to_nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; Spark has no built-in for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_answer(c: Column) -> Column:
    return to_nfc(lf(redact_secrets(c)))


def answer_hash(c: Column) -> Column:
    return F.sha2(normalize_answer(c), 256)


def native_id(*parts: Column) -> Column:
    """Forty hex digits over the JSON array of the parts."""
    return F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 40)


def scope_hash(ids: Column) -> Column:
    """Hash of a sorted id list; null stands for the whole run."""
    return F.sha2(F.coalesce(F.array_join(F.array_sort(ids), "\n"), F.lit("run-container")), 256)


def state_revision(**parts: Column) -> Column:
    """Hash of the canonical JSON of named parts."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def hmac_sha256(text: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex. The key is a job parameter, never a column."""
    import hashlib

    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    first = F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def change_fingerprint(op: Column, parts: Column, secret: str) -> Column:
    """Keyed fingerprint of the change content: 32 hex digits over ``{"v":2,"op":…,"parts":[…]}``."""
    body = F.to_json(F.struct(F.lit(2).alias("v"), op.alias("op"), F.transform(parts, lf).alias("parts")))
    return F.substring(hmac_sha256(body, secret), 1, 32)


def path_fingerprint(paths: Column, secret: str) -> Column:
    body = F.to_json(
        F.struct(F.lit(2).alias("v"), F.lit("paths").alias("op"), F.array_sort(F.array_distinct(paths)).alias("paths"))
    )
    return F.substring(hmac_sha256(body, secret), 1, 32)


def agg_set_lanes(c: Column) -> list[Column]:
    """Order-free digest of a set in four summed lanes; aggregates partially, so no set is collected."""
    digest = F.sha2(c, 256)
    return [
        F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).alias(f"_lane{i}")
        for i in range(4)
    ]
