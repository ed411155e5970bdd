"""Enum domains, loaders, and the stand-in tables: the driver's tables seen as the procurement model.

A stand-in is one SQL text for Spark and DuckDB. Three macros hide what differs: @days(ts, n) adds days, @text(ts) is
the timestamp as text, @secs(a, b) is whole seconds from a to b. Timestamps are UTC without a zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Fixed enum domains.
PROCUREMENT_TYPES = ("TENDER", "RFQ", "RFB", "RFP", "RFI", "EOI", "EXPRESSION_OF_INTEREST", "AUCTION", "OTHER")
STATUSES = ("OPEN", "CLOSED", "CANCELLED", "AWARDED", "EXTENDED", "SUSPENDED", "UNKNOWN")
QUALITIES = ("VALID", "INCOMPLETE", "NEEDS_REVIEW", "INVALID")
EVENT_TYPES = ("OPPORTUNITY_CREATED", "OPPORTUNITY_UPDATED", "DEADLINE_CHANGED", "BRIEFING_CHANGED", "DOCUMENT_ADDED", "DOCUMENT_CHANGED", "DOCUMENT_REMOVED", "CONTACT_CHANGED", "SUBMISSION_CHANGED", "STATUS_CHANGED", "CANCELLED", "EXTENDED", "AWARD_POSTED", "OTHER")
DECISIONS = ("NEW", "EXACT_MATCH", "PROBABLE_MATCH", "UNCERTAIN")
SCHEDULABLE = ("ACTIVE", "DEGRADED", "VERIFIED")

VERIFICATIONS = ("UNVERIFIED", "PASSED", "PASSED_WITH_WARNINGS", "FAILED")
LIFECYCLES = ("DISCOVERED", "PENDING_VERIFICATION", "VERIFIED", "ACTIVE", "DEGRADED", "PAUSED", "DISABLED")

#: Keys and checks of the stored tables: unique keys (with the condition under which they count) and conditions of rows.
CONSTRAINTS: dict[str, dict] = {
    "opportunities": {
        "unique": {"town_reference": ["municipality_id", "reference_number"], "source_external": ["source_id", "external_id"], "fingerprint": ["fingerprint"]},
        "where": {"fingerprint": "data_quality <> 'NEEDS_REVIEW'"},  # uncertain duplicates are kept beside the other, for review
        "checks": {"value": "estimated_value >= 0", "version": "version >= 1"},
    },
    "versions": {"unique": {"opportunity_version": ["opportunity_id", "version"]}, "checks": {"version": "version >= 1"}, "id": "opportunity_id"},
    "documents": {"unique": {"opportunity_url": ["opportunity_id", "url"]}, "checks": {"file_size": "file_size >= 0"}},
    "document_versions": {"unique": {"document_sha": ["document_id", "sha256"]}, "id": "document_id"},
    "sources": {
        "checks": {
            "priority": "priority BETWEEN 0 AND 1000", "interval": "interval_minutes >= 5", "rate": "rate_per_minute > 0", "claim_lease": "claimed_by IS NULL OR claim_expires_at IS NOT NULL",
            "lifecycle": f"lifecycle IN {LIFECYCLES}", "verification": f"verification IN {VERIFICATIONS}", "passed_is_dated": "verification NOT IN ('PASSED', 'PASSED_WITH_WARNINGS') OR verification_at IS NOT NULL",
        },
    },
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

STANDINS: dict[str, str] = {
    "provinces": "SELECT r_regionkey AS id, r_name AS name, substr(r_name, 1, 2) AS code, lower(replace(r_name, ' ', '-')) AS slug FROM region",
    "municipalities": """SELECT n_nationkey AS id, n_name AS name, 'M' || CAST(n_nationkey AS STRING) AS code, lower(replace(n_name, ' ', '-')) AS slug, n_regionkey AS province_id,
        n_nationkey % 6 AS district_id, CASE n_nationkey % 3 WHEN 0 THEN 'METROPOLITAN' WHEN 1 THEN 'DISTRICT' ELSE 'LOCAL' END AS type, n_nationkey % 5 <> 0 AS active FROM nation""",
    "districts": "SELECT DISTINCT n_nationkey % 6 AS id, 'District ' || CAST(n_nationkey % 6 AS STRING) AS name, 'D' || CAST(n_nationkey % 6 AS STRING) AS code FROM nation",
    "sources": """SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug, 'Org ' || CAST(s_suppkey % 9 AS STRING) AS organization, s_nationkey AS municipality_id,
        CASE s_suppkey % 7 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'DEGRADED' WHEN 3 THEN 'PAUSED' WHEN 4 THEN 'VERIFIED' WHEN 5 THEN 'ACTIVE' ELSE 'DISABLED' END AS lifecycle,
        CASE s_suppkey % 5 WHEN 0 THEN 'HEALTHY' WHEN 1 THEN 'DEGRADED' WHEN 2 THEN 'FAILING' WHEN 3 THEN 'OFFLINE' ELSE 'UNKNOWN' END AS health,
        CASE s_suppkey % 4 WHEN 0 THEN 'HTML' WHEN 1 THEN 'JSON' WHEN 2 THEN 'WORDPRESS' ELSE 'OCDS' END AS connector, s_suppkey % 100 AS priority, 60 * (1 + s_suppkey % 12) AS interval_minutes,
        CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 12 ELSE 0 END AS consecutive_failures,
        CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE @days(TIMESTAMP '1998-08-01 00:00:00', 0 - s_suppkey % 11) END AS last_run_at,
        CASE WHEN s_suppkey % 6 = 2 THEN NULL ELSE @days(TIMESTAMP '1998-08-01 00:00:00', 0 - s_suppkey % 13) END AS last_success_at,
        CASE WHEN s_suppkey % 8 = 3 THEN @days(TIMESTAMP '1998-08-03 00:00:00', s_suppkey % 3) END AS next_run_at,
        CASE WHEN s_suppkey % 10 = 7 THEN @days(TIMESTAMP '1998-08-01 00:00:00', s_suppkey % 5) END AS claim_expires_at, s_suppkey % 17 = 3 AS paused FROM supplier""",
    "opportunities": """SELECT o_orderkey AS id, 'REF/' || CAST(o_orderkey % 5000 AS STRING) AS reference_number, 'REF/' || CAST(o_orderkey % 5000 AS STRING) AS reference_number_normalized,
        p_name || ' ' || p_type || ' lot ' || CAST(o_orderkey % 97 AS STRING) AS title, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE p_name || ' for ' || c_mktsegment END AS description,
        CASE o_orderstatus WHEN 'P' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' ELSE 'AWARDED' END AS status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'RFQ' WHEN '2' THEN 'RFP' WHEN '3' THEN 'TENDER' WHEN '4' THEN 'RFI' ELSE 'OTHER' END AS procurement_type,
        'Org ' || CAST(o_custkey % 9 AS STRING) AS organization, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE c_nationkey END AS municipality_id, CASE WHEN o_orderkey % 3 = 0 THEN n_regionkey END AS province_id,
        o_custkey % (SELECT count(*) FROM supplier) AS source_id, CAST(o_orderdate AS TIMESTAMP) AS published_at, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE @days(o_orderdate, o_orderkey % 60) END AS closing_at,
        CAST(o_totalprice AS DECIMAL(18, 2)) AS estimated_value, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'ZAR' END AS currency, 'https://www.example.org/t/' || CAST(o_orderkey AS STRING) AS source_url,
        CASE o_orderkey % 10 WHEN 0 THEN 'INCOMPLETE' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'VALID' END AS data_quality, o_orderkey % 50 = 0 AS is_fixture, o_custkey AS contact_id
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "contacts": "SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '')) || '@example.org' AS email, '011' || CAST(1000000 + c_custkey % 700 AS STRING) AS phone, c_mktsegment AS organization FROM customer",
    "source_runs": """SELECT event_id AS id, user_id AS source_id, CAST(ts AS TIMESTAMP) AS started_at, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 41 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
        CAST(round(value * 100) AS BIGINT) AS duration_ms, CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE event_id % 40 END AS items_found, event_id % 4 AS items_created, event_id % 3 AS items_updated,
        event_id % 5 AS items_failed, event_id % 2 AS items_skipped FROM events""",
    "run_errors": """SELECT event_id AS id, event_id AS run_id, CASE event_id % 4 WHEN 0 THEN 'DISCOVERY' WHEN 1 THEN 'FETCH' WHEN 2 THEN 'PARSE' ELSE 'DOCUMENT' END AS stage, 'E' || CAST(event_id % 7 AS STRING) AS code,
        'message ' || CAST(event_id % 3 AS STRING) AS message, event_id % 3 = 0 AS retryable, CAST(ts AS TIMESTAMP) AS created_at FROM events WHERE event_type = 'error'""",
    "jobs": """SELECT event_id AS id, user_id AS source_id, CASE event_id % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'RETRYING' WHEN 3 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
        CAST(ts AS TIMESTAMP) AS created_at, CASE WHEN event_id % 5 = 1 THEN CAST(ts AS TIMESTAMP) END AS started_at, CASE WHEN event_id % 5 = 2 THEN @days(ts, 1) END AS scheduled_for, event_id % 4 AS attempts, 3 AS max_attempts FROM events WHERE event_id % 3 = 0""",
    "change_events": """SELECT event_id AS id, user_id AS opportunity_id, CASE event_type WHEN 'view' THEN 'DEADLINE_CHANGED' WHEN 'click' THEN 'STATUS_CHANGED' WHEN 'purchase' THEN 'AWARD_POSTED' WHEN 'signup' THEN 'OPPORTUNITY_CREATED' ELSE 'OTHER' END AS event_type,
        CAST(ts AS TIMESTAMP) AS occurred_at FROM events""",
    "api_requests": "SELECT event_id AS id, user_id AS client, CASE user_id % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'STANDARD' ELSE 'PREMIUM' END AS tier, CAST(ts AS TIMESTAMP) AS ts FROM events",
    "observations": """SELECT l_orderkey AS opportunity_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, CAST(l_shipdate AS TIMESTAMP) AS closing_at,
        CASE l_linestatus WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status, CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'Method ' || l_returnflag END AS submission_method,
        'https://www.example.org/d/' || CAST(l_partkey % 5 AS STRING) || '.pdf' AS document_url FROM lineitem""",
    "doc_texts": "SELECT doc_id AS id, doc_id % 97 AS opportunity_id, text AS content, 'doc-' || CAST(doc_id AS STRING) || '.' || CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'html' ELSE 'csv' END AS filename, lang, source, n_chars FROM documents",
}


def render(sql: str, engine: str) -> str:
    """A text with macros as SQL of one engine, spark or duckdb."""
    arg = r"((?:[^(),]|\([^()]*\))+)"
    if engine == "spark":
        sql = re.sub(rf"@days\({arg}, {arg}\)", r"timestampadd(DAY, CAST(\2 AS INT), CAST(\1 AS TIMESTAMP_NTZ))", sql)
        sql = re.sub(rf"@text\({arg}\)", r"date_format(\1, 'yyyy-MM-dd HH:mm:ss')", sql)
        sql = re.sub(rf"@secs\({arg}, {arg}\)", r"timestampdiff(SECOND, \1, \2)", sql)
        return re.sub(r"\bTIMESTAMP\b(?!_)", "TIMESTAMP_NTZ", sql)
    sql = re.sub(rf"@days\({arg}, {arg}\)", r"(CAST(\1 AS TIMESTAMP) + to_days(CAST(\2 AS INTEGER)))", sql)
    sql = re.sub(rf"@text\({arg}\)", r"strftime(\1, '%Y-%m-%d %H:%M:%S')", sql)
    return re.sub(rf"@secs\({arg}, {arg}\)", r"CAST(trunc((epoch_us(\2) - epoch_us(\1)) / 1000000.0) AS BIGINT)", sql)


def used(sql: str) -> list[str]:
    """The stand-ins that a text names, those they need first."""
    out: list[str] = []
    for name in STANDINS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in [*used(STANDINS[name].replace(name, "")), name] if x not in out]
    return out


def duckdb_sql(sql: str) -> str:
    """SQL over stand-ins as DuckDB can run it on the driver's tables."""
    names = used(sql)
    head = ", ".join(f"{n} AS MATERIALIZED ({STANDINS[n]})" for n in names)
    body = sql.lstrip()
    if head and body[:5].upper() == "WITH ":
        recursive = body[5:14].upper() == "RECURSIVE"
        return render(f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body[15:] if recursive else body[5:]}", "duckdb")
    return render(f"WITH {head} {body}" if head else body, "duckdb")


#: The inputs of stand-ins that number rows within a key, and that key: windows sort what a task holds of them.
WINDOWED = {"observations": {"lineitem": "l_orderkey"}}
PART_ROWS = 250_000


def in_bounded_parts(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key so that a task has about PART_ROWS of them however many there are; windows by that key stay there.

    Tables that the session's own number of partitions keeps within that are left to Spark.
    """
    parts = -(-rows.count() // PART_ROWS)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a stand-in over them."""
    if name in STANDINS:
        sql = STANDINS[name]
        inputs = {t: load(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
        for t, key in WINDOWED.get(name, {}).items():
            inputs[t] = in_bounded_parts(inputs[t], key)
        for t in inputs:
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return spark.sql(render(sql, "spark"), **{k: v for k, v in inputs.items() if f"{{{k}}}" in sql})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
