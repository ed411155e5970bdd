"""The column functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import search_names

# Name -> (parameters, SQL expression); Catalyst inlines them.
SQL = {
    "collapse_whitespace": ("t STRING", r"trim(regexp_replace(t, r'\s+', ' '))"),
    "normalize_reference": ("t STRING", r"nullif(regexp_replace(regexp_replace(regexp_replace(upper(t), r'[^A-Z0-9/\-]', ''), r'[/\-]{2,}', '/'), r'^[/\-]+|[/\-]+$', ''), '')"),
    "is_http_url": ("u STRING", r"coalesce(u rlike r'^(?i)\s*https?://[^/?#]+', false)"),
    "ascii_slug": ("t STRING", r"regexp_replace(regexp_replace(lower(t), r'[^a-z0-9]+', '-'), r'^-+|-+$', '')"),
    "short_hash": ("t STRING", "substring(sha2(t, 256), 1, 12)"),
    "trigrams_of": ("t STRING", r"array_distinct(flatten(transform(array_distinct(regexp_extract_all(lower(coalesce(t, '')), r'[\p{L}\p{N}]+', 0)), w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))"),
}
SIMILARITY = "CASE WHEN size(array_union(trigrams_of(a), trigrams_of(b))) = 0 THEN 0D ELSE size(array_intersect(trigrams_of(a), trigrams_of(b))) / size(array_union(trigrams_of(a), trigrams_of(b))) END"


def register_functions(spark: SparkSession) -> list[str]:
    """Creates temporary SQL functions; returns their names."""
    for name, (parameters, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION trigram_similarity(a STRING, b STRING) RETURN {SIMILARITY}")
    return [*SQL, "trigram_similarity", *search_names(spark)]
