"""A batch of items through the whole ingest: normalise, validate, resolve against what is stored, version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.listings import all_rejects
from ..sources.state import materialise
from . import dedup, normalize, validate, versions

KEPT = ("id", "first_seen_at", "version")


def ingest_batch(items: DataFrame, sources: DataFrame, current: DataFrame | None, as_of: str, seen_at: str | None = None) -> dict[str, DataFrame]:
    """Tables of a batch: opportunities (those that it adds or changes), versions, events, decisions, rejects.

    items and sources are those of normalize_items; current is the stored table before the batch, or None. Nothing of
    the size of current is written: its rows are looked up by their keys, and by title in the batch's sources. Items
    of a batch are first resolved among themselves, the earliest published of them stands for the rest; these are
    resolved against current. Exact and probable matches become updates of the record that they match, of several the
    last published; uncertain ones are new records that need review. An update never erases a value by null; a version
    is made when a tracked field changes. Items without a title and invalid records are rejects. What becomes of a row is
    decided by ids; whole rows are then shuffled once to those that go on, and once more only where an update meets its record.
    """
    records, missing = normalize.normalize_items(items, sources, as_of)
    name = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_id", "external_id", "source_url", "content_hash")])
    records = materialise(records.withColumn("id", name))  # else its expressions would be planned again in every use
    keep, invalid = validate.split_persistable(validate.validate_records(records, as_of))
    keep = keep.withColumnRenamed("quality", "data_quality").withColumns({"first_seen_at": F.to_timestamp_ntz(F.lit(seen_at or as_of)), "version": F.lit(1).cast("bigint")})
    keep = _one_of_each(materialise(keep.drop("issues")))
    roots = dedup.resolve_batch(keep)
    firsts = roots.where("id = root").select("id")
    if current is None:
        decisions = firsts.select("id", F.lit(None).cast("bigint").alias("existing_id"), F.lit(None).cast("int").alias("layer"), F.lit("NEW").alias("decision"), F.lit(1.0).alias("confidence"), F.lit("no match").alias("reason"))
    else:
        decisions = materialise(dedup.resolve_duplicates(keep.join(firsts, "id", "left_semi"), current, stored=True))
    fields = [c for c in keep.columns if c not in KEPT]
    rows = materialise(keep.join(materialise(_wanted(keep.select("id", "published_at"), roots, decisions)), "id"))
    updates = rows.where("target IS NOT NULL").select(F.col("target").alias("id"), *fields)
    fresh = dedup.noted(rows.where("target IS NULL").drop("target")).withColumn("fresh", F.lit(True))
    base = fresh.where("updated").drop("updated")
    if current is not None:
        base = base.unionByName(current.withColumn("fresh", F.lit(False)))
    after = versions.merge_updates(base, updates).unionByName(fresh.where("NOT updated").drop("updated"), allowMissingColumns=True)
    after = materialise(after)
    changed = after.where(F.size("changed_fields") > 0)
    made = after.where(F.col("fresh") | (F.size("changed_fields") > 0)).select("id", "version", "title", "status")
    return {"opportunities": after.drop("fresh", "changed_fields"), "versions": made, "events": versions.semantic_events(changed), "decisions": decisions, "rejects": all_rejects(missing, invalid)}


def _one_of_each(rows: DataFrame) -> DataFrame:
    """rows with one row of each id; ids alone are shuffled, and whole rows only if any id is repeated."""
    repeated = materialise(rows.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        return rows
    return materialise(rows.join(repeated, "id", "left_anti").unionByName(rows.join(repeated, "id", "left_semi").dropDuplicates(["id"])))


def _wanted(dated: DataFrame, roots: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, target, updated, duplicate_review): the rows that go on, and no others. A new record has no target, and `updated`
    if rows of the batch update it; of the rows that update a target the last published goes on.
    """
    merged, uncertain = F.col("decision").isin("EXACT_MATCH", "PROBABLE_MATCH"), F.col("decision") == "UNCERTAIN"
    said = decisions.select(F.col("id").alias("root"), (~merged).alias("new"), F.when(merged, F.col("existing_id")).otherwise(F.col("id")).alias("target"), F.when(uncertain, F.struct("existing_id", "layer", "confidence", "reason")).alias("duplicate_review"))
    placed = materialise(roots.join(said, "root").select("id", "target", (F.col("new") & (F.col("id") == F.col("root"))).alias("new"), "duplicate_review"))
    last = placed.where("id != target").select("id", "target").join(dated, "id").groupBy("target").agg(F.max(F.struct("published_at", "id"))["id"].alias("id"))
    last = materialise(last)
    fresh = placed.where("new").join(last.select(F.col("target").alias("id"), F.lit(True).alias("updated")), "id", "left")
    none = lambda c: F.lit(None).cast(placed.schema[c].dataType).alias(c)
    fresh = fresh.select("id", none("target"), F.coalesce("updated", F.lit(False)).alias("updated"), "duplicate_review")
    return fresh.unionByName(last.select("id", "target", F.lit(None).cast("boolean").alias("updated"), none("duplicate_review")))
