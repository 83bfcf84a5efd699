"""Ordered redaction rules for free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule name, pattern, ignore case, replacement; applied in order.
REDACTION_RULES: list[tuple[str, str, bool, str]] = [
    ("bearer", r"(Bearer\s+)[A-Za-z0-9_\-\.]{12,}", True, "$1[REDACTED_TOKEN]"),
    ("api_key", r"\b(?:sk-[a-zA-Z0-9_\-]{16,})\b", False, "[REDACTED_API_KEY]"),
    ("hex_key", r"\b[0-9a-fA-F]{64}\b", False, "[REDACTED_KEY]"),
    ("gstin", r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", False, "[REDACTED_GSTIN]"),
    ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", False, "[REDACTED_PAN]"),
    ("uid", r"\b\d{4}[ -]\d{4}[ -]\d{4}\b|\b\d{12}\b", False, "[REDACTED_AADHAAR]"),
    ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", False, "[REDACTED_IFSC]"),
    ("account", r"\b\d{9,18}\b", False, "[REDACTED_ACCOUNT]"),
]

# Keys whose whole value is replaced, exact and by part.
LARGE_PAYLOAD_KEYS = [
    "ocr_text", "full_text", "prompt", "ai_prompt", "response_text", "raw_content", "ai_response",
]
SECRET_KEY_PARTS = [
    "encryption_key", "jwt_secret", "secret_key", "password", "api_key", "ai_api_key",
    "authorization", "bearer", "token",
]


def _pattern(rule: tuple[str, str, bool, str]) -> str:
    return ("(?i)" if rule[2] else "") + rule[1]


def redact(col: Column, secrets: list[str] | None = None) -> Column:
    """Text with every rule applied in order; known secrets go first."""
    for secret in secrets or []:
        col = F.replace(col, F.lit(secret), F.lit("[REDACTED_KEY]"))
    for rule in REDACTION_RULES:
        col = F.regexp_replace(col, _pattern(rule), rule[3])
    return col


def redaction_counts(redacted: Column, original: Column) -> dict[str, Column]:
    """Per-rule replacement counts, read off the tokens the rules inserted.

    Counting tokens in the redacted text (minus those already in the input)
    costs a substring scan per rule instead of a second pass of every pattern.
    """

    def occurrences(text: Column, token: str) -> Column:
        gone = F.replace(text, F.lit(token), F.lit(""))
        return ((F.length(text) - F.length(gone)) / F.lit(len(token))).cast("int")

    counts = {}
    for name, _, _, replacement in REDACTION_RULES:
        token = replacement.removeprefix("$1")
        counts[name] = occurrences(redacted, token) - occurrences(original, token)
    return counts


def redact_entry(key: Column, value: Column) -> Column:
    """A map value redacted by its key name, else by the text rules."""
    k = F.lower(key)
    secret = k.rlike("|".join(SECRET_KEY_PARTS))
    return (
        F.when(k.isin(LARGE_PAYLOAD_KEYS), F.lit("[REDACTED_LARGE_PAYLOAD]"))
        .when(secret, F.lit("[REDACTED_SECRET]"))
        .otherwise(redact(value))
    )
