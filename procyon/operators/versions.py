"""Version history, semantic change events, and document versions, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed lists: the tracked fields, and the events of those that have their own.
TRACKED = ("reference_number", "title", "description", "procurement_type", "status", "organization", "published_at", "closing_at", "estimated_value", "currency", "submission_method", "submission_url", "submission_address", "briefing_required", "briefing_compulsory", "briefing_date", "briefing_location", "source_url", "canonical_url")
FIELD_EVENTS = {"closing_at": "DEADLINE_CHANGED", "briefing_date": "BRIEFING_CHANGED", "briefing_location": "BRIEFING_CHANGED", "status": "STATUS_CHANGED", "submission_method": "SUBMISSION_CHANGED", "submission_url": "SUBMISSION_CHANGED", "submission_address": "SUBMISSION_CHANGED"}
STATUS_EVENTS = {"CANCELLED": "CANCELLED", "EXTENDED": "EXTENDED", "AWARDED": "AWARD_POSTED"}


def changes(old: list[Column], new: list[Column], names: list[str]) -> Column:
    """Map of field to struct(from, to); a null new value never counts."""
    pairs = [x for n, a, b in zip(names, old, new, strict=True) for x in (F.lit(n), F.struct(a.cast("string").alias("from"), b.cast("string").alias("to")))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v["to"].isNotNull() & ~v["from"].eqNullSafe(v["to"]))


def diff_records(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """(key, changed_fields) of the rows in both that changed."""
    names = [f for f in TRACKED if f in existing.columns and f in incoming.columns]
    a, b = existing.alias("a"), incoming.alias("b")
    out = a.join(b, key).select(key, changes([F.col(f"a.{n}") for n in names], [F.col(f"b.{n}") for n in names], names).alias("changed_fields"))
    return out.where(F.size("changed_fields") > 0)


def diff_documents(existing: DataFrame, incoming: DataFrame, key: str = "id", urls: str = "urls") -> DataFrame:
    """(key, added, removed) as sorted arrays."""
    out = existing.select(key, F.col(urls).alias("old")).join(incoming.select(key, F.col(urls).alias("new")), key)
    return out.select(key, F.sort_array(F.array_except("new", "old")).alias("added"), F.sort_array(F.array_except("old", "new")).alias("removed"))


def event_of(field: Column, new: Column) -> Column:
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by_status = F.when(field == "status", F.try_element_at(table(STATUS_EVENTS), F.coalesce(new, F.lit(""))))
    return F.coalesce(by_status, F.try_element_at(table(FIELD_EVENTS), field), F.lit("OPPORTUNITY_UPDATED"))


def semantic_events(changed: DataFrame, key: str = "id", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, event_type, field, previous_value, new_value) for each changed field."""
    rows = changed.select(key, *more, F.explode("changed_fields").alias("field", "v"))
    return rows.select(key, *more, event_of(F.col("field"), F.col("v.to")).alias("event_type"), "field", F.col("v.from").alias("previous_value"), F.col("v.to").alias("new_value"))


def document_events(diff: DataFrame, changed: DataFrame, key: str = "id", emit_removed: str = "with_change") -> DataFrame:
    """DOCUMENT_ADDED for each new URL; DOCUMENT_REMOVED with another change only, or always."""
    added = diff.select(key, F.explode("added").alias("url")).select(key, F.lit("DOCUMENT_ADDED").alias("event_type"), "url")
    removed = diff.select(key, "added", F.explode("removed").alias("url"))
    if emit_removed == "with_change":
        other = changed.select(key).union(diff.where(F.size("added") > 0).select(key)).distinct()
        removed = removed.join(other, key, "left_semi")
    return added.union(removed.select(key, F.lit("DOCUMENT_REMOVED").alias("event_type"), "url"))


def snapshot(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, snapshot): the record as JSON with its hashes and quality."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("snapshot"))


def version_history(observations: DataFrame, key: str, order: list[str], fields: list[str], document: str | None = None) -> DataFrame:
    """One row for each observation that made a version: version number, values then in force, changed_fields.

    A field's value is the last one that is not null; a new version starts when a field changes or a document URL is
    seen for the first time for its key.
    """
    w = W.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    out = observations
    if document:
        first = F.row_number().over(W.partitionBy(key, document).orderBy(*order)) == 1
        out = out.withColumn("__new_doc", F.coalesce(F.col(document).isNotNull() & first, F.lit(False)))
    for f in fields:
        out = out.withColumn(f"__{f}", F.last(f, ignorenulls=True).over(upto))
    for f in fields:
        out = out.withColumn(f"__old_{f}", F.lag(f"__{f}").over(w))
    out = out.withColumn("__first", F.row_number().over(w) == 1)
    out = out.withColumn("changed_fields", F.when(~F.col("__first"), changes([F.col(f"__old_{f}") for f in fields], [F.col(f"__{f}") for f in fields], fields)))
    made = F.col("__first") | (F.size("changed_fields") > 0) | (F.col("__new_doc") if document else F.lit(False))
    out = out.withColumn("__made", made).withColumn("version", F.sum(F.col("__made").cast("bigint")).over(upto)).where("__made")
    return out.select(key, *order, "version", *[F.col(f"__{f}").alias(f) for f in fields], *([F.col("__new_doc").alias("document_added")] if document else []), "changed_fields")


def apply_updates(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """existing with the changes of incoming: null never erases; the version grows when a tracked field changed."""
    changed = diff_records(existing, incoming, key).select(key, F.lit(1).alias("__up"))
    b = incoming.select(key, *[F.col(c).alias(f"__{c}") for c in incoming.columns if c != key and c in existing.columns])
    out = existing.join(b, key, "left").join(changed, key, "left")
    return out.select(key, *[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in out.columns and c != "version" else F.col(c) for c in existing.columns if c not in (key, "version")], (F.coalesce("version", F.lit(1)) + F.coalesce("__up", F.lit(0))).alias("version"))


def merge_updates(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """The rows of existing that incoming has, as apply_updates makes them, with changed_fields as diff_records has them (an
    empty map without a change), by one join.
    """
    shared = [c for c in existing.columns if c in incoming.columns and c != key]
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    names = [f for f in TRACKED if f in shared]
    value = lambda c: F.coalesce(b(c), a(c)).alias(c) if c in shared and c != "version" else a(c)
    both = existing.alias("a").join(incoming.alias("b"), key)
    out = both.select(key, *[value(c) for c in existing.columns if c != key], changes([a(n) for n in names], [b(n) for n in names], names).alias("changed_fields"))
    return out.withColumn("version", F.coalesce("version", F.lit(1)) + (F.size("changed_fields") > 0).cast("int"))


def document_versions(fetches: DataFrame, document: str, sha: str, at: str) -> DataFrame:
    """(document, sha, first_at, version, current): a version for each content first seen."""
    seen = fetches.groupBy(document, sha).agg(F.min(at).alias("first_at"))
    w = W.partitionBy(document).orderBy("first_at", sha)
    return seen.withColumn("version", F.row_number().over(w)).withColumn("current", F.lead(sha).over(w).isNull())


def sync_documents(known: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of keys in seen that are not registered yet, once each."""
    return seen.select(*keys).dropna().dropDuplicates().join(known.select(*keys).distinct(), keys, "left_anti")


def newest_first(df: DataFrame, key: str, at: str, limit: int = 500) -> DataFrame:
    """At most `limit` rows for each key, newest first."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc(), "id"))
    return df.withColumn("position", n).where(F.col("position") <= limit)


def change_feed(events: DataFrame, event_type: str | None = None, opportunity: int | None = None, after: str | None = None) -> DataFrame:
    out = events
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    if opportunity is not None:
        out = out.where(F.col("opportunity_id") == opportunity)
    if after is not None:
        out = out.where(F.col("occurred_at") > F.to_timestamp_ntz(F.lit(after)))
    return out
