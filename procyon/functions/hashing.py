"""Identity hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed list: the fields of a record's content, in the order in which they are hashed.
CONTENT = ("briefing_date", "briefing_location", "briefing_required", "canonical_url", "closing_at", "currency", "description", "estimated_value", "organization", "procurement_type", "published_at", "reference_number", "status", "submission_address", "submission_method", "submission_url", "title")


def canonical_json(names: tuple[str, ...], columns: list[str]) -> Column:
    """A struct of the fields in alphabetical order as JSON, absent ones as null."""
    return F.to_json(F.struct(*[(F.col(n) if n in columns else F.lit(None).cast("string")).alias(n) for n in sorted(names)]), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def content_hash(columns: list[str]) -> Column:
    return F.sha2(canonical_json(CONTENT, columns), 256)


def fold(text: Column) -> Column:
    """Lower case, other than letters and digits as single hyphens, trimmed; null is empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(""))


def fingerprint(title: Column, organization: Column, closing_at: Column, procurement_type: Column) -> Column:
    day = F.coalesce(F.date_format(closing_at, "yyyy-MM-dd"), F.lit(""))
    parts = (("title", fold(title)), ("organization", fold(organization)), ("closing_at", day), ("procurement_type", fold(procurement_type)))
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), v) for n, v in parts]), 256)


def contact_fingerprint(name: Column, email: Column, phone: Column, organization: Column) -> Column:
    digits = F.right(F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]", ""), F.lit(9))
    return F.sha2(F.concat_ws("|", fold(name), F.lower(F.trim(F.coalesce(email, F.lit("")))), digits, fold(organization)), 256)


def short_hash(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def storage_key(sha: Column, extension: Column) -> Column:
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha, F.lit("."), extension)
