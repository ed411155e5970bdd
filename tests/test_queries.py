"""Registered queries against their SQL on the smallest tables, and streams against their batch twins."""

import numpy as np
import pandas as pd
import pytest

from procyon.operators import versions
from procyon.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def shown(df):
    def show(x):
        if x is None or x is pd.NA or isinstance(x, (bool, np.bool_)):
            return "None" if x is None or x is pd.NA else f"{float(x):.6f}"
        try:
            return "None" if x != x else f"{float(x):.6f}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(show(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["f1_list_tenders", "f10_sorted_page", "j5_tender_detail", "a1_platform_statistics", "n10_parse_datetime", "n14_normalize_url", "v1_v3_validate", "n25_first_line", "n32_normalize_items", "d1_dedup_reference", "d2_dedup_content_hash", "d3_dedup_fingerprint", "d4_dedup_trigram", "d6_reference_conflict_guard", "d7_resolve_duplicates", "d7_exact_layers", "d9_d10_review_queue", "d8_resolve_within_batch", "d11_duplicate_candidates", "e5_version_history", "o5_source_health", "o15_reconcile_report", "s10_listing_chain", "t3_quota_windows", "t4_source_health", "t6_exact_dedup"])
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert shown(QUERIES[name](spark, SF).toPandas()) == shown(con.sql(SQL[name]).df())


def test_every_part_has_a_class(spark):
    test_sql_agrees(spark, "d11_duplicate_classes")
    rows = QUERIES["d11_duplicate_classes"](spark, SF).where("kind = 'member'").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()


def test_every_opportunity_is_looked_up(spark):
    from procyon.model import load

    ids = {r.id + 10_000_000 for r in load(spark, SF, "opportunities").select("id").collect()}
    rows = QUERIES["d7_resolve_duplicates"](spark, SF).collect()
    assert {r.id for r in rows} == ids and len(rows) == len(ids)
    assert len({r.id % 4 for r in QUERIES["d4_dedup_trigram"](spark, SF).select("id").collect()}) == 4


@pytest.mark.parametrize("name", ["t1_ingest", "t5_versions", "t7_late_counts"])
def test_streams_in_turns_agree_with_sql(spark, name):
    test_sql_agrees(spark, name)


def test_whole_batch_is_resolved_as_by_loops(spark):
    from procyon.plans.registry import Tables, whole_batch

    from .test_operators import plain_batch

    _, root = plain_batch(whole_batch(Tables(spark, SF)))
    assert {r.id: r.root for r in QUERIES["d8_resolve_batch"](spark, SF).collect()} == root and len(set(root.values())) < len(root)


def test_ids_of_a_batch_are_distinct_however_high_the_keys(spark, tmp_path):
    """Orders beyond ten million: what is seen again has other ids than what is stored."""
    from procyon.plans.registry import Tables, whole_batch

    for name in ("region", "nation", "customer", "supplier", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 60")
    orders.union(orders.withColumn("o_orderkey", orders["o_orderkey"] + 10_000_000)).write.parquet(str(tmp_path / "orders.parquet"))
    ids = [r.id for r in whole_batch(Tables(spark, str(tmp_path))).select("id").collect()]
    roots = QUERIES["d8_resolve_batch"](spark, str(tmp_path)).collect()
    assert len(set(ids)) == len(ids) == 240 and sorted(r.id for r in roots) == sorted(ids)


def test_snapshots_are_the_records(spark):
    import json

    from procyon.operators import validate
    from procyon.plans.registry import AS_OF, Tables

    rows = {r.id: r.asDict(True) for r in validate.validate_records(Tables(spark, SF).opportunities, AS_OF).collect()}
    got = {r.id: json.loads(r.snapshot) for r in QUERIES["e4_snapshot"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    for i, want in rows.items():
        assert set(got[i]) == set(want) - {"id"}
        for k, v in got[i].items():
            if isinstance(v, str) and hasattr(want[k], "isoformat"):
                assert v.startswith(want[k].isoformat(timespec="seconds"))
            else:
                assert v == want[k] or float(v) == float(want[k])


def test_rejects_of_every_stage(spark):
    import json

    from procyon.plans.registry import Tables

    t = Tables(spark, SF)
    rows = QUERIES["u3_all_rejects"](spark, SF).collect()
    invalid = sorted((o.source_id, o.source_url) for o in t.opportunities.collect() if o.id % 101 == 0)
    assert sorted((r.source_id, r.url) for r in rows if r.stage == "VALIDATE") == invalid
    assert all("title" in json.loads(r.message) and r.code == "RECORD_INVALID" and not r.retryable for r in rows if r.stage == "VALIDATE")
    broken = sorted(e.user_id for e in t.events.collect() if e.event_id % 50 == 0)
    assert sorted(r.source_id for r in rows if r.stage != "VALIDATE") == broken


def test_document_links_of_whole_pages(spark):
    import re

    got = sorted((r.page_id, r.source_url, r.title) for r in QUERIES["s7_s8_pdf_link_items"](spark, SF).collect())
    want = {}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        for link, words in re.findall(r'<a href="(/[^"]*)"[^>]*>(.*?)</a>', p.html, re.S):
            words = re.sub(r"\s+", " ", re.sub("<[^>]*>", "", words)).strip()
            want.setdefault((p.page_id, link), (p.page_id, p.url, words or link.rsplit("/", 1)[-1] + ".pdf"))
    assert got == sorted(want.values())


def test_open_sessions_are_there(spark, tmp_path):
    from pyspark.sql import functions as F

    test_sql_agrees(spark, "t7_edit_sessions")
    # users 1 and 2 are active in the last minutes; a gap of just 30 minutes is no break
    at = [(1, "10:00:00"), (1, "10:30:00"), (1, "11:00:01"), (2, "11:00:00"), (3, "08:00:00")]
    events = spark.createDataFrame([(i, u, "edit", f"2024-01-01 {t}", 1.0, "") for i, (u, t) in enumerate(at)], "event_id bigint, user_id bigint, event_type string, ts string, value double, props string")
    events.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    (part,) = (tmp_path / "events.parquet").glob("part-*.parquet")
    (tmp_path / "one").mkdir()
    part.rename(tmp_path / "one/events.parquet")
    got = {tuple(r) for r in QUERIES["t7_edit_sessions"](spark, str(tmp_path / "one")).collect()}
    assert got == {(1, "2024-01-01 10:00:00", 2), (1, "2024-01-01 11:00:01", 1), (2, "2024-01-01 11:00:00", 1), (3, "2024-01-01 08:00:00", 1)}


def test_stale_alerts(spark):
    rows = QUERIES["t8_stale_alerts"](spark, SF).collect()
    assert all(r.last_success_ms > 0 for r in rows)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


def test_no_generated_method_is_too_long_to_be_compiled(spark):
    name, was = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set(name, 65535)
        QUERIES["n32_normalize_items"](spark, SF)
        assert spark.conf.get(name) == "8000"
        spark.conf.set(name, 5000)
        QUERIES["n32_normalize_items"](spark, SF)
        assert spark.conf.get(name) == "5000"  # a user's own setting is kept
    finally:
        spark.conf.set(name, was)
