"""Aggregates and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .query import with_geography


def one_row(*tables: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    keyed = [t.withColumn("__one", F.lit(1)) for t in tables]
    return reduce(lambda a, b: a.join(b, "__one"), keyed).drop("__one")


def platform_statistics(opportunities: DataFrame, documents: DataFrame, sources: DataFrame, municipalities: DataFrame, as_of: str) -> DataFrame:
    """One row of totals; each table is read once."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    real = ~F.col("is_fixture")
    is_open = real & (F.col("status") == "OPEN")
    soon = is_open & F.col("closing_at").between(now, now + F.make_dt_interval(F.lit(7)))
    o = opportunities.agg(F.count_if(real).alias("total"), F.count_if(is_open).alias("open"), F.count_if(soon).alias("closing_soon"), F.count_if("is_fixture").alias("fixtures"))
    d = documents.agg(F.count("*").alias("documents"), F.count_if(F.length("content") > 0).alias("documents_with_text"))
    s = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("lifecycle") == "ACTIVE").alias("active_sources"), F.countDistinct("municipality_id").alias("municipalities_with_source"))
    return one_row(o, d, s, municipalities.agg(F.count("*").alias("municipalities")))


def count_by(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    return df.where("NOT is_fixture").groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("name").asc_nulls_last()).limit(limit)


def count_by_province(df: DataFrame, municipalities: DataFrame, provinces: DataFrame) -> DataFrame:
    """Counted by municipality and province first, so that the join is with counts."""
    counts = df.where("NOT is_fixture").groupBy("municipality_id", "province_id").agg(F.count("*").alias("k"))
    return with_geography(counts, municipalities, provinces).groupBy("province_name").agg(F.sum("k").alias("n"))


def count_by_health(sources: DataFrame) -> DataFrame:
    return sources.groupBy("health").agg(F.count("*").alias("n"), F.max("consecutive_failures").alias("most_failures"))


def platform_totals(opportunities: DataFrame, runs: DataFrame, documents: DataFrame) -> DataFrame:
    o = opportunities.agg(F.count("*").alias("opportunities"), F.count_if(F.col("data_quality") == "VALID").alias("valid"), F.max("published_at").alias("__p")).select("opportunities", "valid", F.date_format("__p", "yyyy-MM-dd HH:mm:ss").alias("newest_published"))
    r = runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "FAILED").alias("failed_runs"), F.sum("items_found").alias("items_found"))
    d = documents.agg(F.sum(F.octet_length("content")).alias("bytes"))
    return one_row(o, r, d)


def statistics_by(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, name, n) of each dimension alone, in one pass over the rows."""
    named = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("name")) for d in dims])
    return df.where("NOT is_fixture").select(F.explode(named).alias("x")).groupBy("x.dimension", "x.name").agg(F.count("*").alias("n"))


def statistics_cube(df: DataFrame, dims: list[str]) -> DataFrame:
    """All combinations of dims, with the mask of those rolled up."""
    return df.where("NOT is_fixture").cube(*dims).agg(F.grouping_id().alias("mask"), F.count("*").alias("n"), F.sum("estimated_value").alias("value"))


def dedup_decision_report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.coalesce("layer", F.lit(0)).alias("layer"), "decision").agg(F.count("*").alias("n"))


def run_rollup(items: DataFrame, run: str = "run_id") -> DataFrame:
    """Counters of each run over decided items (decision, layer, quality, changed, failed)."""
    is_new, dup = F.col("decision") == "NEW", F.col("decision").isin("EXACT_MATCH", "PROBABLE_MATCH")
    bad = F.col("quality") == "INVALID"
    return items.groupBy(run).agg(F.count("*").alias("found"), F.count_if("failed").alias("failed"), F.count_if(bad).alias("invalid"), F.count_if(is_new & ~bad).alias("created"), F.count_if(dup & F.col("changed")).alias("updated"), F.count_if(dup & ~F.col("changed")).alias("unchanged"), F.count_if(F.col("decision") == "EXACT_MATCH").alias("duplicates_exact"), F.count_if(F.col("decision") == "PROBABLE_MATCH").alias("duplicates_fuzzy"), F.count_if(F.col("decision") == "UNCERTAIN").alias("uncertain"))


def duration_histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """(le, n, cumulative): rows up to each bound, the last null for what is above all."""
    bucket = F.lit(None).cast("double")
    for b in reversed(bounds):
        bucket = F.when(value <= b, float(b)).otherwise(bucket)
    counts = df.where(value.isNotNull()).groupBy(bucket.alias("le")).agg(F.count("*").alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(W.orderBy(F.col("le").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)))


def document_outcomes(df: DataFrame) -> DataFrame:
    """(method, outcome, n, needs_ocr) of documents (method, text)."""
    empty = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    return df.groupBy("method", F.when(F.col("method") == "NONE", "unsupported").when(empty, "empty").otherwise("extracted").alias("outcome")).agg(F.count("*").alias("n"), F.count_if(empty & (F.col("method") == "NATIVE_PDF")).alias("needs_ocr"))
