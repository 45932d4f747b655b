"""Keyed tokens for identifiers, as pure Catalyst expressions."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespaces in which identifiers are tokenised.
NAMESPACES = (
    "patient_id", "member_id", "provider_id", "claim_id", "payer_claim_control_number", "payer_id", "patient_name",
    "member_name", "provider_name", "payer_name", "entity_name", "member_dob", "reference_id", "unknown",
)


def token_key() -> str:
    """The key of the deployment: no default, as a printed key would protect nothing."""
    key = os.environ.get("EDILAKE_TOKEN_KEY")
    if not key:
        raise ValueError("EDILAKE_TOKEN_KEY is not set, and no key was passed")
    return key


def token(namespace: str | Column, raw: Column, key: str | None = None) -> Column:
    """First 16 bytes of HMAC-SHA256(key, namespace:raw) in hex; an empty value stays empty, null stays null.

    The key's pads are literals of the plan, so plans and event logs must be
    redacted where the key is secret (spark.redaction.string.regex).
    """
    secret = (key or token_key()).encode()
    secret = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    secret = secret.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    ns = namespace if isinstance(namespace, Column) else F.lit(namespace)
    message = F.encode(F.concat(ns, F.lit(":"), raw), "ISO-8859-1")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.when(raw == "", F.lit("")).otherwise(F.substring(digest, 1, 32))


def token_sql(namespace: str, raw: str, key: str | None = None) -> str:
    """The same in DuckDB's SQL."""
    secret = (key or token_key()).encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in secret).hex() for pad in (0x36, 0x5C))
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('{namespace}:' || {raw})))), 1, 32)"
