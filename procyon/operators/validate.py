"""Validation of canonical records: issues, completeness, quality, and the constraints of the model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_http_url
from ..model import CONSTRAINTS

LEAST_TITLE, FUTURE_YEARS, PAST_YEARS = 8, 10, 25
WEIGHTS = {"reference_number": 0.15, "description": 0.15, "published_at": 0.15, "closing_at": 0.20, "organization": 0.10, "documents": 0.15, "contact": 0.10}


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def checks(df: DataFrame, as_of: str) -> list[tuple[str, str, str, Column]]:
    """(severity, field, message, condition) in order; hard ones make a record invalid, review ones send it to review."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    days = lambda n: F.make_dt_interval(F.lit(n))
    title, published, closing = F.trim(F.coalesce(_has(df, "title"), F.lit(""))), _has(df, "published_at", "timestamp_ntz"), _has(df, "closing_at", "timestamp_ntz")
    value = _has(df, "estimated_value", "decimal(18,2)")
    docs = F.exists("documents", lambda d: ~is_http_url(d)) if "documents" in df.columns else F.lit(False)
    return [
        ("hard", "title", "missing", title == ""),
        ("hard", "title", f"shorter than {LEAST_TITLE} characters", (title != "") & (F.length(title) < LEAST_TITLE)),
        ("hard", "source_url", "missing or not a valid http(s) URL", ~is_http_url(_has(df, "source_url"))),
        ("hard", "source_id", "missing", _has(df, "source_id").isNull()),
        ("review", "published_at", "publication date is in the future", published > now + days(2)),
        ("review", "published_at", "publication date is implausibly old", published < now - days(365 * PAST_YEARS)),
        ("review", "closing_at", "closing date is implausibly far in the future", closing > now + days(365 * FUTURE_YEARS)),
        ("review", "closing_at", "closing date precedes the publication date", closing < published - days(1)),
        ("review", "estimated_value", "negative value", value < 0),
        ("soft", "currency", "value present without a currency", value.isNotNull() & _has(df, "currency").isNull()),
        ("soft", "submission_url", "not a valid http(s) URL", _has(df, "submission_url").isNotNull() & ~is_http_url(_has(df, "submission_url"))),
        ("review", "documents", "invalid document URL", docs),
        ("soft", "procurement_type", "could not be determined from the source", _has(df, "procurement_type") == "OTHER"),
        ("soft", "status", "could not be determined from the source", _has(df, "status") == "UNKNOWN"),
        ("soft", "reference_number", "not published by the source", F.coalesce(_has(df, "reference_number"), F.lit("")) == ""),
        ("soft", "closing_at", "not published or not parseable", closing.isNull()),
    ]


def completeness(df: DataFrame) -> Column:
    def present(name: str) -> Column:
        if name not in df.columns:
            return F.lit(False)
        if name == "documents":
            return F.coalesce(F.size(name) > 0, F.lit(False))
        return F.coalesce(F.col(name).cast("string") != "", F.lit(False)) if name != "contact" else F.col(name).isNotNull()

    return F.round(reduce(lambda a, b: a + b, [F.when(present(n), w).otherwise(0.0) for n, w in WEIGHTS.items()]), 3)


def validate_records(df: DataFrame, as_of: str) -> DataFrame:
    """df with issues (map of field to messages), completeness and quality."""
    tests = checks(df, as_of)
    listed = F.filter(F.array(*[F.when(c, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for _, f, m, c in tests]), lambda x: x.isNotNull())
    fields = F.array_distinct(F.transform("__issues", lambda x: x["field"]))
    issues = F.map_from_arrays(fields, F.transform(fields, lambda f: F.transform(F.filter("__issues", lambda x: x["field"] == f), lambda x: x["message"])))
    hit = lambda kind: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for k, _, _, c in tests if k == kind])
    out = df.withColumn("__issues", listed).withColumn("completeness", completeness(df)).withColumn("__hard", hit("hard")).withColumn("__review", hit("review"))
    quality = F.when(F.col("__hard"), "INVALID").when(F.col("__review"), "NEEDS_REVIEW").when(F.col("completeness") >= 0.7, "VALID").when(F.col("completeness") >= 0.3, "INCOMPLETE").otherwise("NEEDS_REVIEW")
    return out.withColumn("issues", issues).withColumn("quality", quality).drop("__issues", "__hard", "__review")


def split_persistable(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to keep, error rows of the invalid ones)."""
    errors = validated.where("quality = 'INVALID'").select("source_id", "source_url", F.lit("VALIDATE").alias("stage"), F.lit("RECORD_INVALID").alias("code"), F.to_json("issues").alias("message"))
    return validated.where("quality != 'INVALID'"), errors


def quality_report(validated: DataFrame) -> DataFrame:
    """(kind, name, n): records by quality and by field with an issue, in one pass."""
    named = F.concat(F.array(F.struct(F.lit("quality").alias("kind"), F.col("quality").alias("name"))), F.transform(F.map_keys("issues"), lambda k: F.struct(F.lit("issue").alias("kind"), k.alias("name"))))
    return validated.select(F.explode(named).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def constraint_violations(df: DataFrame, unique: dict[str, list[str]], checks: dict[str, str], id_col: str = "id", where: dict[str, str] | None = None) -> DataFrame:
    """(rule, key, n): repeated keys with their number of rows, and rows that break a check.

    A key counts if all its parts are present and the condition that `where` may give for its rule holds. A check that
    is null is not broken. All rules are evaluated in one scan; a row then gives its keys and the checks that it breaks
    as short rows, and each task counts the keys before one shuffle. A row that breaks a check is a row of its own.
    """
    told = lambda rule, key, broken: F.struct(F.lit(rule).alias("rule"), key.alias("key"), F.lit(broken).alias("broken"))
    found = []
    for rule, keys in unique.items():
        counts = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & F.coalesce(F.expr((where or {}).get(rule, "true")), F.lit(False))
        found.append(F.when(counts, told(rule, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), False)))
    for rule, test in checks.items():
        found.append(F.when(~F.coalesce(F.expr(test), F.lit(True)), told(rule, F.col(id_col).cast("string"), True)))
    rows = df.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"), F.monotonically_increasing_id().alias("row")).select("x.*", "row")
    each = rows.groupBy("rule", "key", F.when(F.col("broken"), F.col("row")).alias("broken")).agg(F.count("*").alias("n")).where("broken IS NOT NULL OR n > 1")
    return each.select("rule", "key", "n")


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, key, n) over the tables of model.CONSTRAINTS that are given."""
    out = []
    for name, df in tables.items():
        rules = CONSTRAINTS[name]
        found = constraint_violations(df, rules.get("unique", {}), rules.get("checks", {}), rules.get("id", "id"), rules.get("where"))
        out.append(found.select(F.lit(name).alias("table"), "rule", "key", "n"))
    return reduce(DataFrame.unionByName, out)
