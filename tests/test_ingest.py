"""The whole ingest of two batches on a few items, and the keyed table under it."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from procyon.operators.ingest import ingest_batch
from procyon.sources import state
from procyon.sources.state import KeyedTable

AS_OF = "2026-01-01 00:00:00"
SIGNS = {"title": "Supply of road signs for the northern depot", "reference": "SCM/1/2026", "description": "signs", "date": "2025-12-01", "deadline": "5 March 2026", "status": "open"}
PUMPS = {"title": "Maintenance of pumps and valves in the region", "reference": "SCM/2/2026", "description": "pumps", "date": "2025-12-02", "deadline": "6 March 2026", "status": "open"}


def test_two_batches(spark, tmp_path):
    sources = spark.createDataFrame([(1, "City", 5, None, "https://www.example.org/", "Africa/Johannesburg")], "id bigint, organization string, municipality_id bigint, province_id bigint, base_url string, source_timezone string")
    items = lambda *rows: spark.createDataFrame([(1, f"https://www.example.org/{name}", fields) for name, fields in rows], "source_id bigint, source_url string, fields map<string,string>")
    first = ingest_batch(items(("a", SIGNS), ("b", PUMPS), ("c", {"title": "  "}), ("a", SIGNS)), sources, None, AS_OF)
    table = KeyedTable(spark, str(tmp_path / "opportunities"), buckets=4)
    table.write(first["opportunities"], 0)
    current = table.read(0)
    assert current.count() == 2 and {r.version for r in first["versions"].collect()} == {1}
    assert [r.code for r in first["rejects"].collect()] == ["MISSING_TITLE"]
    second = ingest_batch(items(("a2", {**SIGNS, "status": "cancelled"}), ("d", {**PUMPS, "title": "Security services at the harbour", "reference": "SCM/3/2026", "description": "guards"})), sources, current, AS_OF)
    assert {r.decision for r in second["decisions"].collect()} == {"EXACT_MATCH", "NEW"}
    assert {r.title for r in second["opportunities"].collect()} == {SIGNS["title"], "Security services at the harbour"}
    table.write(second["opportunities"], 1)
    after = {r.title: (r.version, r.status) for r in table.read(1).collect()}
    assert after == {SIGNS["title"]: (2, "CANCELLED"), PUMPS["title"]: (1, "OPEN"), "Security services at the harbour": (1, "OPEN")}
    assert "CANCELLED" in {r.event_type for r in second["events"].collect()}
    assert sorted(r.version for r in second["versions"].collect()) == [1, 2]


def size_of(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_keyed_table_equals_a_dict(spark, tmp_path):
    """Many batches of new and changed rows: the table is what a dict would be, and holds little more than that."""
    table, want, r = KeyedTable(spark, str(tmp_path / "t"), buckets=3), {}, random.Random(1)
    for batch in range(9):
        rows = {r.randrange(60): batch * 1000 + i for i in range([40, 3, 5, 0, 30, 2, 2, 25, 1][batch])}
        want |= rows
        table.write(spark.createDataFrame(list(rows.items()), "id bigint, v bigint"), batch)
        assert {x.id: x.v for x in table.read(batch).collect()} == want
    assert len(list((tmp_path / "t" / "manifest").glob("batch=*"))) == 2
    parts = {p.part for b in (7, 8) for p in table.parts(b)}
    assert {str(p.parent.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("bucket=*/*.parquet")} == parts


def test_replayed_batch_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    batches = [[(i, 0) for i in range(50)], [(3, 1), (70, 1)], [(3, 2), (4, 2)]]
    frames = [spark.createDataFrame(b, "id bigint, v bigint") for b in batches]
    for batch, df in enumerate(frames):
        table.write(df, batch)
    before = sorted(map(tuple, table.read(2).collect())), sorted(map(str, table.parts(2)))
    table.write(frames[2], 2)  # as after a crash behind the manifest
    assert (sorted(map(tuple, table.read(2).collect())), sorted(map(str, table.parts(2)))) == before
    table.write(frames[2].where("id = 3"), 2)  # as after one before it, with other rows
    assert {x.id: x.v for x in table.read(2).collect()}[4] == 0


def test_bytes_written_go_with_the_batch(spark, tmp_path):
    wide = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=8)
    table.write(wide, 0)
    whole = size_of(tmp_path / "t" / "data" / "batch=0")
    table.write(wide.where("id % 400 = 7"), 1)
    assert size_of(tmp_path / "t" / "data" / "batch=1") < whole / 40 and not (tmp_path / "t" / "rewritten").exists()
    assert table.read(1).count() == 40_000


def test_scratch_deletes_what_was_saved_within_it(spark):
    with state.scratch(spark):
        state.materialise(spark.range(3))
        (path,) = state._scopes[-1]
        assert os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:")) and not state._scopes


def test_rows_wait_in_buckets_however_many_keys(spark, monkeypatch):
    from procyon.streaming import streams

    monkeypatch.setattr(streams, "BUCKETS", 3)
    monkeypatch.setattr(streams, "PACKED", 7)
    day = lambda n: f"timestamp'2024-01-{n:02d}'"
    rows = spark.range(300).selectExpr("nullif(id, 299) AS opportunity_id", "explode(array(1L, 2L, 3L)) AS seq").selectExpr("*", "timestampadd(DAY, CAST(seq AS INT), timestamp'2024-01-01') AS at", "'a' || seq % 2 AS status", "'u' || least(seq, 2) AS document_url")
    end = spark.sql(f"SELECT -1L AS opportunity_id, 1L AS seq, {day(30)} AS at, CAST(NULL AS STRING) AS status, CAST(NULL AS STRING) AS document_url")
    turns = [rows.where("seq != 1"), rows.where("seq = 1"), end]
    out = streams.run_in_turns(turns, lambda s: streams.stream_versions(s, ["status"], late="5 days")).where("opportunity_id IS NULL OR opportunity_id >= 0")
    got = sorted(((r.opportunity_id, r.seq, r.version, r.status, r.document_added) for r in out.collect()), key=str)
    want = [(i, seq, seq, f"a{seq % 2}", seq < 3) for i in [*range(299), None] for seq in (1, 2, 3)]
    assert got == sorted(want, key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_updates_are_merged_by_one_join(spark):
    from procyon.operators import versions

    row = "id bigint, title string, status string, closing_at timestamp_ntz, version bigint"
    old = spark.createDataFrame([(1, "a", "OPEN", None, 3), (2, "b", "OPEN", None, None), (3, "c", "OPEN", None, 1)], row)
    new = spark.createDataFrame([(1, "a2", None, None, 1), (2, None, "OPEN", None, 1), (9, "z", "OPEN", None, 1)], row)
    merged = versions.merge_updates(old, new)
    apart = versions.apply_updates(old, new).join(new.select("id"), "id", "left_semi")
    assert sorted(map(tuple, merged.select(*apart.columns).collect())) == sorted(map(tuple, apart.collect())) == [(1, "a2", "OPEN", None, 4), (2, "b", "OPEN", None, 1)]
    assert {r.id: set(r.changed_fields) for r in merged.collect()} == {1: {"title"}, 2: set()}


def test_a_row_of_a_batch_is_shuffled_once_by_its_keys(spark):
    from procyon.operators import dedup

    batch = spark.range(9).selectExpr("id", "id % 3 AS source_id", "'h' || id % 2 AS content_hash", "nullif('R' || id % 4, 'R0') AS reference_number_normalized", "timestamp_ntz'2026-01-01' AS published_at")
    found = dedup._earliest(batch, ["content_hash", "source_id"], "published_at")
    assert plan_of(found).count("Exchange hashpartitioning") == 1
    # 6 is as 0, which has no reference; 7 as 1 but of another reference; 8 has none and is as 2
    assert {r.own.id: r.first.id for r in found.collect()} == {6: 0, 8: 2}


def test_one_later_part_of_a_bucket_needs_no_ranks(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=2)
    table.write(spark.range(40).selectExpr("id", "0L AS v"), 0)
    table.write(spark.range(4).selectExpr("id", "1L AS v"), 1)
    after = table.read(1)
    assert "Window" not in plan_of(after) and {r.id: r.v for r in after.collect()} == {i: int(i < 4) for i in range(40)}


def test_repeated_items_of_a_batch_are_one(spark):
    sources = spark.createDataFrame([(1, "City", 5, None, "https://www.example.org/", "Africa/Johannesburg")], "id bigint, organization string, municipality_id bigint, province_id bigint, base_url string, source_timezone string")
    item = lambda name, fields: (1, f"https://www.example.org/{name}", fields)
    rows = [item("a", SIGNS), item("a", SIGNS), item("b", {**SIGNS, "date": "2025-12-09", "status": "awarded"}), item("c", {**SIGNS, "date": "2025-12-08", "status": "cancelled"}), item("d", PUMPS)]
    found = ingest_batch(spark.createDataFrame(rows, "source_id bigint, source_url string, fields map<string,string>"), sources, None, AS_OF)
    # of the two that update the first, the last published counts
    assert sorted((r.title, r.version, r.status) for r in found["versions"].collect()) == sorted([(SIGNS["title"], 2, "AWARDED"), (PUMPS["title"], 1, "OPEN")])
    assert {(r.event_type, r.new_value) for r in found["events"].collect()} >= {("AWARD_POSTED", "AWARDED")}


def test_what_a_step_saved_on_its_way_is_deleted(spark):
    kept = []

    def make():
        kept.append(state.materialise(spark.range(4)))
        return kept[0].where("id > 1")

    with state.scratch(spark):
        out = state.materialise_alone(spark, make)
        (path,) = state._scopes[-1]
        assert sorted(r.id for r in out.collect()) == [2, 3] and os.path.exists(path.removeprefix("file:"))
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            kept[0].collect()
    assert not os.path.exists(path.removeprefix("file:"))
