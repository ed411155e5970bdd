"""Relative URLs, containment in JSON, constraints, long chains and smoothed durations against plain Python."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from procyon.functions import urls
from procyon.operators import ops, query, validate
from procyon.sources import pages, state


def test_relative_urls_as_the_standard_has_them(spark):
    """The examples of RFC 3986, section 5.4, with a base without parameters, and made-up ones; urljoin is the judge."""
    links = ["g", "./g", "g/", "/g", "?y", "g?y", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "//other.org/a/../b", "https://x.org/a/../b", "a//b", "/a//b/./..", "x/../../../../y/.", "..?q=1", "a/.hidden"]
    bases = ["http://a.org/b/c/d", "http://a.org", "http://a.org/", "https://a.org/x/y/z/?k=v"]
    r = random.Random(4)
    links += ["/".join(r.choice(["..", ".", "a", "b", ""]) for _ in range(r.randrange(1, 7))) + r.choice(["", "?z=1"]) for _ in range(150)]
    links = [x for x in links if not x.startswith("//") or x.startswith("//other") if x]
    rows = [(b, x) for b in bases for x in links]
    got = spark.createDataFrame(rows, "base string, link string").select("base", "link", urls.normalize_url(F.col("link"), F.col("base")).alias("url")).collect()
    for row in got:
        want = urljoin(row.base, row.link).split("#")[0]
        scheme, rest = want.split("://")
        assert row.url == (want if "/" in rest else want.replace(rest, rest.split("?")[0] + "/" + rest[len(rest.split("?")[0]):])), (row.base, row.link)


def contains(doc, probe, top=True):
    """JSONB's @> over Python values."""
    if isinstance(probe, dict):
        return isinstance(doc, dict) and all(k in doc and contains(doc[k], v, False) for k, v in probe.items())
    if isinstance(probe, list):
        return isinstance(doc, list) and all(any(contains(d, p, False) for d in doc) for p in probe)
    if top and isinstance(doc, list):
        return any(contains(d, probe, False) for d in doc)
    return not isinstance(doc, (dict, list)) and isinstance(doc, bool) == isinstance(probe, bool) and (doc is None) == (probe is None) and isinstance(doc, str) == isinstance(probe, str) and doc == probe


def test_json_containment_equals_a_recursion(spark):
    import json

    docs = [{"a": 1, "b": {"c": [1, "x", {"d": None}]}}, {"a": "1"}, {"a": 1.0}, {"a": True}, {"a": None}, [1, 2, [3]], ["x", {"a": 1}], [], {}, 5, "x", None, {"it's": {"q\"": {"b'\"": 1}}}, {"a": 0.1}, {"b": {"c": [[1, 2], [3]]}}, {"a": 10**25}]
    probes = [*docs, {"b": {"c": ["x"]}}, {"b": {"c": [{"d": None}]}}, {"b": {"c": [{}]}}, {"b": {}}, [2, 1, 1], [[3]], {"a": 2}, {"b": {"c": [[2]]}}, 1]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, "no json"), (91, None)], "id int, doc string").cache()
    for probe in probes:
        got = {r.id for r in query.json_containment(df, "doc", probe).collect()}
        assert got == {i for i, d in enumerate(docs) if contains(d, probe)}, probe


def test_each_rule_finds_what_breaks_it(spark):
    rows = [(1, 5, "R", 10, "ok"), (2, 5, "R", -1, "ok"), (3, None, "R", None, "ok"), (4, 6, "R", 3, "draft"), (5, 6, "R", 4, "ok"), (5, 7, None, -2, "ok"), (5, 7, None, -2, "ok")]
    df = spark.createDataFrame(rows, "id int, town int, ref string, value int, state string")
    got = sorted(map(tuple, validate.constraint_violations(df, {"town_ref": ["town", "ref"], "id": ["id"]}, {"value": "value >= 0"}, where={"town_ref": "state = 'ok'"}).collect()))
    assert got == [("id", "5", 3), ("town_ref", "5|R", 2), ("value", "2", 1), ("value", "5", 1), ("value", "5", 1)]
    assert validate.constraint_violations(df.where("false"), {"id": ["id"]}, {"value": "value >= 0"}).count() == 0


def test_long_chains_and_loops(spark):
    n = 20_000
    far = spark.range(n).select(F.concat(F.lit("p"), "id").alias("url"), F.when(F.col("id") < n - 1, F.concat(F.lit("p"), F.col("id") + 1)).alias("next_url"), (F.col("id") == 0).alias("is_first"))
    chain = pages.listing_chain(far, None)
    assert chain.count() == n and chain.where("url != concat('p', depth - 1)").count() == 0
    rows = [("a", "b", True), ("b", "c", False), ("c", "b", True), ("d", "d", True), ("e", "gone", True), ("e", None, True), (None, "a", True), ("f", "a", True), ("f", "b", True)]
    loop = spark.createDataFrame(rows, "url string, next_url string, is_first boolean")
    got = {(r.start, r.url, r.depth) for r in pages.listing_chain(loop, None).collect()}
    assert got == {("a", "a", 1), ("a", "b", 2), ("a", "c", 3), ("c", "c", 1), ("c", "b", 2), ("d", "d", 1), ("e", "e", 1), ("f", "f", 1), ("f", "a", 2), ("f", "b", 3), ("f", "c", 4)}
    assert {r.url for r in pages.listing_chain(far, 6).collect()} == {f"p{i}" for i in range(6)}
    assert pages.listing_chain(loop.where("false")).count() == 0


@pytest.mark.parametrize("tail", [2, 64])
def test_smoothed_durations_by_a_bounded_tail(spark, tail):
    r = random.Random(3)
    runs = [(s, i, f"2024-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", r.choice([10, 500, 90_000, r.randrange(5000)]) if r.random() > 0.1 else None) for s, n in ((1, 700), (2, 3), (3, 1), (4, 90)) for i in range(n)]
    runs += [(5, 1, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(runs, "source_id int, id int, started_at string, duration_ms int").repartition(5)
    want = {}
    from decimal import ROUND_HALF_UP, Decimal

    for s, _, _, ms in sorted(runs, key=lambda x: (x[0], x[2], x[1])):
        if ms is not None:
            want[s] = float(ms) if s not in want else float(Decimal(repr(want[s] * 0.7 + ms * (1 - 0.7))).quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert {x.source_id: x.average_ms for x in ops.response_time_ewma(df, tail=tail).collect()} == want


def test_repeated_updates_of_one_key_agree_between_runs(spark):
    target = spark.createDataFrame([(1, "a", 1)], "id int, name string, n int")
    updates = spark.createDataFrame([(1, "b", None), (1, "c", 5), (2, None, 7), (2, "x", 1)], "id int, name string, n int")
    runs = [sorted(map(tuple, state.upsert(target, updates.repartition(k), ["id"]).collect())) for k in (1, 3, 4)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 2
