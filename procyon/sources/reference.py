"""Reference data: municipalities from CSV, source definitions from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..functions.urls import is_http_url, url_policy
from .state import upsert

COLUMNS = ("code", "name", "type", "province_code", "district_code", "official_website")


def import_municipalities(rows: DataFrame, provinces: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(municipalities after the import, counts by outcome). existing (code, name, type, province_id, district_code, website).

    A row of an unknown province, or without code or name, is skipped; an invalid website becomes null.
    """
    missing = [c for c in COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    p = provinces.select(F.upper("code").alias("__pc"), F.col("id").alias("province_id"))
    keyed = rows.withColumn("__pc", F.upper(F.trim("province_code"))).join(p, "__pc", "left")
    good = F.col("province_id").isNotNull() & (F.coalesce(F.trim("code"), F.lit("")) != "") & (F.coalesce(F.trim("name"), F.lit("")) != "")
    clean = keyed.where(good).select(F.trim("code").alias("code"), F.trim("name").alias("name"), F.upper("type").alias("type"), "province_id", "district_code", F.when(is_http_url(F.col("official_website")), F.col("official_website")).alias("website"))
    known = existing.select("code", F.lit(True).alias("__known"))
    counts = keyed.withColumn("code", F.trim("code")).join(known, "code", "left").select(F.when(~good, "skipped").when(F.col("__known"), "updated").otherwise("created").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))
    return upsert(existing, clean, ["code"]), counts


def import_sources(rows: DataFrame, connectors: list[str], municipalities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, skipped with a reason). rows (name, base_url, connector, municipality_code, slug, scope)."""
    m = municipalities.select(F.col("code").alias("municipality_code"), F.col("id").alias("municipality_id"))
    out = rows.join(m, "municipality_code", "left")
    reason = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name").when(~url_policy(F.col("base_url"))["ok"], F.concat(F.lit("url: "), url_policy(F.col("base_url"))["reason"])).when(~F.coalesce(F.col("connector").isin(connectors), F.lit(False)), "connector").when(F.col("municipality_code").isNotNull() & F.col("municipality_id").isNull(), "municipality")
    out = out.withColumn("reason", reason).withColumn("slug", F.coalesce(F.nullif(F.trim("slug"), F.lit("")), slugify(F.col("name")))).withColumn("scope", F.when(F.col("municipality_id").isNotNull(), "MUNICIPAL").otherwise(F.coalesce("scope", F.lit("NATIONAL"))))
    return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL").select("name", "base_url", "reason")
