"""Operators on small tables: duplicates, versions, validation, queries, operations, readers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from procyon.functions.text import trigrams
from procyon.operators import classify, dedup, normalize, ops, query, search, similarity, validate, versions
from procyon.sources import documents, listings, pages, reference, state

AS_OF = "2026-01-01 00:00:00"


def test_similarity_join_equals_all_pairs(spark):
    r = random.Random(2)
    words = ["supply", "of", "road", "signs", "street", "lights", "water", "pipes", "pump", "repair", "roads"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 6))), i % 3) for i in range(120)]
    df = spark.createDataFrame([*rows, (500, None, 0), (501, "", 0)], "id bigint, title string, source_id bigint")
    sets = {x.id: (set(x.g), x.source_id) for x in df.select("id", "source_id", trigrams(F.col("title")).alias("g")).collect()}
    for least in (0.65, 0.82):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a][1] == sets[b][1] and sets[a][0] | sets[b][0] and len(sets[a][0] & sets[b][0]) / len(sets[a][0] | sets[b][0]) > least}
        got = {(x.left_id, x.right_id) for x in similarity.duplicate_candidates(df, least, block=("source_id",)).collect()}
        assert got == want and want


@pytest.mark.parametrize("most", [1024, 25, 1])
def test_only_large_blocks_are_joined_by_trigrams(spark, monkeypatch, most):
    r = random.Random(3)
    words = ["supply", "of", "road", "signs", "street", "lights", "water", "pipes"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 6))), i % 3 if i < 60 else 0) for i in range(90)]  # blocks of 50, 20 and 20
    df = spark.createDataFrame([*rows, (500, None, 0), (501, "", 1), (502, "road signs", None), (503, "road signs", None)], "id bigint, title string, source_id bigint")
    sets = {x.id: (set(x.g), x.source_id) for x in df.select("id", "source_id", trigrams(F.col("title")).alias("g")).collect()}
    want = {(a, b) for a in sets for b in sets if sets[a][1] == sets[b][1] is not None and sets[a][0] | sets[b][0] and len(sets[a][0] & sets[b][0]) / len(sets[a][0] | sets[b][0]) > 0.65}
    monkeypatch.setattr(similarity, "MOST", most)
    joined, by_trigrams = [], similarity._by_trigrams
    monkeypatch.setattr(similarity, "_by_trigrams", lambda left, right, **k: joined.append(right) or by_trigrams(left, right, **k))
    got = [(x.left_id, x.right_id) for x in similarity.similar_pairs(df, df, 0.65, block=("source_id",)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert [{x.source_id for x in df.select("source_id").distinct().collect()} for df in joined] == {1024: [], 25: [{0}], 1: [{0, 1, 2}]}[most]


def test_equal_titles_keep_their_members(spark):
    df = spark.createDataFrame([(3, "Road signs"), (1, "road signs"), (2, "Water pumps"), (7, "road signs"), (9, None), (8, None), (4, "Street lights"), (5, "Street lights")], "id bigint, title string")
    got = [tuple(x) for x in similarity.duplicate_classes(df, 0.8).collect()]
    assert {x[1:3] for x in got if x[0] == "member"} == {(1, 1), (1, 3), (1, 7), (2, 2), (4, 4), (4, 5), (8, 8), (9, 9)} and len(got) == 8


def records(spark, rows):
    from procyon.plans.registry import with_keys

    df = spark.createDataFrame(rows, "id bigint, reference_number string, title string, source_id bigint, municipality_id bigint, closing_at string, organization string, procurement_type string, published_at string")
    return with_keys(df.withColumn("reference_number_normalized", F.col("reference_number")).withColumn("closing_at", F.to_timestamp_ntz("closing_at")).withColumn("published_at", F.to_timestamp_ntz("published_at")))


def test_four_layers(spark):
    day, seen = "2026-03-01 10:00:00", "2026-01-01 00:00:00"
    long = "Supply and delivery of road signs to the depot"
    old = records(spark, [(1, "A/1", "First", 1, 7, day, "Org", "RFQ", seen), (2, None, "Second tender", 1, None, day, "Org", "RFQ", seen), (3, "C/3", "Third tender", 2, 8, day, "Org", "RFQ", seen), (4, None, long, 3, None, day, "Org", "RFP", seen), (5, "A/1", "Other town", 1, 9, day, "Org", "RFQ", seen)])
    new = records(
        spark,
        [
            (11, "A/1", "Changed", 5, 7, day, "Org", "RFQ", seen), (12, None, "Second tender", 1, None, day, "Org", "RFQ", seen), (13, None, "Third tender", 9, 8, day, "Org", "RFQ", seen), (14, None, "Third tender", 9, 5, day, "Org", "RFQ", seen),
            (15, "X/9", "Third tender", 2, 8, day, "Org", "RFQ", seen), (16, None, long + " yard", 3, None, "2026-03-03 10:00:00", "Org", "RFP", seen), (17, None, long + " yard", 3, None, "2026-03-09 10:00:00", "Org", "RFP", seen), (18, "Z/1", "Brand new", 1, 7, day, "Org", "RFQ", seen),
        ],
    )
    got = {r.id: (r.existing_id, r.layer, r.decision) for r in dedup.resolve_duplicates(new, old).collect()}
    assert got[11] == (1, 1, "EXACT_MATCH") and got[12] == (2, 2, "EXACT_MATCH") and got[13] == (3, 3, "PROBABLE_MATCH") and got[14] == (3, 3, "UNCERTAIN")
    assert got[15] == (None, None, "NEW") and got[16][:2] == (4, 4) and got[17][2] == got[18][2] == "NEW"


def test_batch_roots_are_transitive(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 2), (3, "b", "y", 3), (4, "c", "y", 4), (5, None, None, 5), (6, None, None, 6)], "id bigint, k1 string, k2 string, at int")
    got = {r.id: r.root for r in dedup.resolve_within_batch(df, "at", ["k1", "k2"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def plain_batch(batch):
    """What match_within_batch and resolve_batch say of a batch, by loops: (id -> match, id -> root)."""
    sets = {x.id: set(x.g) for x in batch.select("id", trigrams(F.col("title")).alias("g")).collect()}
    items = sorted(batch.collect(), key=lambda x: (x.published_at is None, str(x.published_at), x.id))
    scope = lambda x: ("s", x.source_id) if x.municipality_id is None else ("m", x.municipality_id)
    known = lambda *values: all(v is not None for v in values)
    want, root = {}, {}
    for n, x in enumerate(items):
        before, m = items[:n], None
        free = [e for e in before if not known(x.reference_number, e.reference_number) or x.reference_number == e.reference_number]
        if e := next((e for e in before if known(x.reference_number) and x.reference_number == e.reference_number and scope(x) == scope(e)), None):
            m = (e.id, 1, "EXACT_MATCH")
        elif e := next((e for e in free if x.content_hash == e.content_hash and x.source_id == e.source_id), None):
            m = (e.id, 2, "EXACT_MATCH")
        elif e := next((e for e in free if x.fingerprint == e.fingerprint), None):
            town = known(x.municipality_id, e.municipality_id) and x.municipality_id == e.municipality_id
            apart = x.source_id == e.source_id and known(x.municipality_id, e.municipality_id) and not town
            m = (e.id, 3, "PROBABLE_MATCH" if not apart and (town or x.source_id == e.source_id) else "UNCERTAIN")
        elif len(x.title) >= 25:
            fits = [e for e in free if x.source_id == e.source_id and (not known(x.closing_at, e.closing_at) or abs((x.closing_at - e.closing_at).total_seconds()) <= 3 * 86400) and (x.municipality_id is None or x.municipality_id == e.municipality_id)]
            best = min(((-len(sets[x.id] & sets[e.id]) / len(sets[x.id] | sets[e.id]), e.id) for e in fits), default=(0, None))
            if -best[0] > 0.65:
                m = (best[1], 4, "PROBABLE_MATCH" if -best[0] >= 0.82 else "UNCERTAIN")
        want[x.id] = m or (None, None, "NEW")
        root[x.id] = root[m[0]] if m and m[2] != "UNCERTAIN" else x.id
    return want, root


def test_batch_is_resolved_by_four_layers(spark):
    r = random.Random(5)
    titles = ["Supply and delivery of road signs to the depot", "Supply and delivery of road signs to the depot yard", "Repair of water pumps at the northern plant", "Repair of water pumps at northern plant site", "Short title"]
    days = ["2026-03-01 10:00:00", "2026-03-03 10:00:00", "2026-03-20 10:00:00", None]
    rows = [(i, r.choice([None, None, "A/1", "B/2", "C/3"]), r.choice(titles), r.randrange(1, 4), r.choice([None, 7, 8]), r.choice(days), r.choice(["Org", "Org", "Other"]), "RFQ", r.choice([None, "2026-01-01 00:00:00", "2026-01-02 00:00:00", "2026-01-03 00:00:00"])) for i in range(1, 121)]
    batch = records(spark, rows)
    want, root = plain_batch(batch)
    got = {x.id: (x.existing_id, x.layer, x.decision) for x in dedup.match_within_batch(batch).collect()}
    assert got == want and {m[1:] for m in want.values()} >= {(1, "EXACT_MATCH"), (2, "EXACT_MATCH"), (3, "PROBABLE_MATCH"), (3, "UNCERTAIN"), (4, "PROBABLE_MATCH"), (None, "NEW")}
    assert {x.id: x.root for x in dedup.resolve_batch(batch).collect()} == root


def test_batch_is_computed_once(spark):
    day, seen = "2026-03-01 10:00:00", "2026-01-01 00:00:00"
    batch = records(spark, [(i, None, f"Repair of water pumps at plant {i % 3}", 1, 7, day, "Org", "RFQ", seen) for i in range(1, 11)])
    computed = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: computed.add(1) or x).asNondeterministic()
    got = {x.id: x.root for x in dedup.resolve_batch(batch.withColumn("organization", told("organization")).withColumn("fingerprint", F.concat("fingerprint", "organization"))).collect()}
    assert len(got) == 10 and set(got.values()) == {1} and computed.value == 10


def test_windows_of_observations_sort_bounded_parts(spark, monkeypatch):
    from procyon import model
    from procyon.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    want = sorted(tuple(r) for r in QUERIES["e5_version_history"](spark, folder).collect())
    monkeypatch.setattr(model, "PART_ROWS", 100)
    got = QUERIES["e5_version_history"](spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert model.load(spark, folder, "observations").rdd.getNumPartitions() == got.rdd.getNumPartitions() == -(-lines // 100)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_versions_and_events(spark):
    obs = spark.createDataFrame([(1, 1, "OPEN", "d1", "u1"), (1, 2, "OPEN", "d1", "u1"), (1, 3, None, "d2", "u1"), (1, 4, "CANCELLED", None, "u2"), (1, 5, "CANCELLED", "d2", "u1")], "id bigint, seq bigint, status string, closing_at string, url string")
    got = versions.version_history(obs, "id", ["seq"], ["status", "closing_at"], "url").orderBy("seq").collect()
    assert [(r.seq, r.version, r.status, r.closing_at, r.document_added) for r in got] == [(1, 1, "OPEN", "d1", True), (3, 2, "OPEN", "d2", False), (4, 3, "CANCELLED", "d2", True)]
    events = versions.semantic_events(versions.version_history(obs, "id", ["seq"], ["status", "closing_at"]).where("size(changed_fields) > 0")).collect()
    assert {(e.event_type, e.field) for e in events} == {("DEADLINE_CHANGED", "closing_at"), ("CANCELLED", "status")}
    a = spark.createDataFrame([(1, ["x", "y"])], "id bigint, urls array<string>")
    b = spark.createDataFrame([(1, ["y", "z"])], "id bigint, urls array<string>")
    d = versions.diff_documents(a, b)
    none = spark.createDataFrame([], "id bigint")
    assert sorted(r.event_type for r in versions.document_events(d, none).collect()) == ["DOCUMENT_ADDED", "DOCUMENT_REMOVED"]
    only_gone = versions.diff_documents(a, spark.createDataFrame([(1, ["y"])], "id bigint, urls array<string>"))
    assert versions.document_events(only_gone, none).count() == 0 and versions.document_events(only_gone, none, emit_removed="always").count() == 1


def test_validation(spark):
    rows = [(1, "Supply of signs", "https://a.org/", 1, "R1", "2025-12-01 00:00:00", "2026-02-01 00:00:00", "d", "Org"), (2, "", "https://a.org/", 1, None, None, None, None, None), (3, "Supply of signs", "https://a.org/", 1, "R1", "2025-12-01 00:00:00", "2025-11-01 00:00:00", "d", "Org"), (4, "Supply of signs", "https://a.org/", 1, None, None, "2026-02-01 00:00:00", None, "Org"), (5, "Supply of signs", "nope", 1, "R1", None, None, "d", None)]
    df = spark.createDataFrame(rows, "id bigint, title string, source_url string, source_id bigint, reference_number string, published_at string, closing_at string, description string, organization string")
    df = df.withColumn("published_at", F.to_timestamp_ntz("published_at")).withColumn("closing_at", F.to_timestamp_ntz("closing_at"))
    got = {r.id: r for r in validate.validate_records(df, AS_OF).collect()}
    assert [got[i].quality for i in range(1, 6)] == ["VALID", "INVALID", "NEEDS_REVIEW", "INCOMPLETE", "INVALID"]
    assert got[3].issues == {"closing_at": ["closing date precedes the publication date"]} and got[1].completeness == 0.75
    keep, errors = validate.split_persistable(validate.validate_records(df, AS_OF))
    assert keep.count() == 3 and errors.count() == 2


def test_normalise_items(spark):
    items = spark.createDataFrame([(1, "/t/1", {"title": " Request for quotation: signs ", "closing_date": "15 September 2026 at 11:00", "value": "R 10,000.50", "description": "Mail Desk@A.org or 011 123 4567. Non-compulsory briefing"}), (1, "/t/2", {"summary": "no title"}), (9, "https://b.org/t", {"name": "Something awarded", "status": "Award-ed"})], "source_id bigint, source_url string, fields map<string,string>")
    src = spark.createDataFrame([(1, "Africa/Johannesburg", "City", 3, None, "https://a.org/")], "id bigint, source_timezone string, organization string, municipality_id bigint, province_id bigint, base_url string")
    good, bad = normalize.normalize_items(items, src, AS_OF)
    a, b = good.orderBy("source_id").collect()
    assert (a.procurement_type, a.status, a.currency, str(a.estimated_value), a.organization, a.source_url) == ("RFQ", "OPEN", "ZAR", "10000.50", "City", "https://a.org/t/1")
    assert a.closing_at.hour == 9 and a.briefing_compulsory is False and (a.contact.email, a.contact.phone) == ("desk@a.org", "0111234567")
    assert b.status == "AWARDED" and b.organization is None and bad.count() == 1


def test_filters_refuse_nonsense(spark):
    with pytest.raises(ValueError):
        query.TenderFilter(published_from="2026-02-01", published_to="2026-01-01")
    with pytest.raises(ValueError):
        query.sort_tenders(spark.range(1), "secret")


def test_search(spark):
    df = spark.createDataFrame([(1, "Road sign repairs, road signs and roads"), (2, "Road sign"), (3, "Water pumps")], "id bigint, words string")
    index = search.inverted_index(df, "words")
    assert [r.id for r in search.search_ranked(index, "the road signs").collect()] == [1, 2]
    assert {r.id for r in search.search_boolean(index, [["pump*"], ["sign", "repair"]]).collect()} == {1, 3}
    assert query.json_containment(spark.createDataFrame([(1, '{"a": {"b": 2}, "c": "x"}'), (2, '{"a": 2}'), (3, "junk")], "id int, j string"), "j", {"a": {"b": 2}, "c": "x"}).count() == 1


def test_classify_and_resolve(spark):
    docs = spark.createDataFrame([("addendum 1.pdf", "bid document"), ("x.pdf", "Scope of Work attached"), (None, None), ("award.pdf", "")], "filename string, body string")
    got = [(r.document_type, r.confidence) for r in classify.classify_documents(docs, text="body").collect()]
    assert got == [("ADDENDUM", 0.9), ("SPECIFICATION", 0.64), ("UNKNOWN", 0.0), ("AWARD_NOTICE", 0.9)]
    towns = spark.createDataFrame([(1, "Cape Town", "cape-town", "CPT"), (2, "Twin", "twin", "T1"), (3, "Twin", "twin-2", "T2")], "id bigint, name string, slug string, code string")
    asked = spark.createDataFrame([(" cape  TOWN ",), ("cpt",), ("twin",), ("Twin-2",), (None,)], "place string")
    assert [r.municipality_id for r in classify.resolve_municipality(asked, "place", towns).orderBy(F.col("place").asc_nulls_last()).collect()].count(None) == 2


def test_reconciliation_is_idempotent(spark):
    jobs = spark.createDataFrame([(1, 1, "QUEUED", "2025-12-01 00:00:00", None, None, 0, 3), (2, 1, "RUNNING", "2025-12-31 23:59:00", "2025-12-31 23:59:00", None, 0, 3), (3, 2, "RETRYING", "2025-12-01 00:00:00", None, "2025-12-02 00:00:00", 3, 3)], "id bigint, source_id bigint, status string, created_at string, started_at string, scheduled_for string, attempts int, max_attempts int")
    for c in ("created_at", "started_at", "scheduled_for"):
        jobs = jobs.withColumn(c, F.to_timestamp_ntz(c))
    found = {(r.id, r.state, r.action) for r in ops.stuck_jobs(jobs, AS_OF).collect()}
    assert found == {(1, "QUEUED_STALE", "REQUEUE"), (3, "RETRY_OVERDUE", "FAIL")}
    fixed = jobs.withColumn("status", F.when(F.col("id") == 3, "FAILED").otherwise(F.col("status"))).withColumn("created_at", F.when(F.col("id") == 1, F.to_timestamp_ntz(F.lit(AS_OF))).otherwise(F.col("created_at")))
    assert ops.stuck_jobs(fixed, AS_OF).count() == 0


def test_health_and_ewma(spark):
    runs = spark.createDataFrame([(i, 1, "FAILED" if i > 3 else "COMPLETED", i, 100 * i) for i in range(1, 9)] + [(20, 2, "FAILED", 1, 50)], "id bigint, source_id bigint, status string, started_at bigint, duration_ms bigint")
    got = {r.source_id: (r.consecutive_failures, r.health) for r in ops.source_health(runs).collect()}
    assert got == {1: (5, "FAILING"), 2: (1, "DEGRADED")}
    x = 100.0
    for i in range(2, 9):
        x = round(x * 0.7 + 100 * i * 0.3, 2)
    assert {r.source_id: r.average_ms for r in ops.response_time_ewma(runs).collect()} == {1: pytest.approx(x), 2: 50.0}


def test_readers(spark):
    raw = spark.createDataFrame([(1, "https://a.org/list", json.dumps({"data": {"items": [{"id": 5, "title": "T", "links": {"self": "/x"}, "files": [{"url": "/f.pdf", "title": "F"}, {"url": "ftp://no"}]}, 7, {"title": None}]}})), (1, "https://a.org/bad", "{")], "source_id bigint, url string, body string")
    items, rejects = listings.json_listing_items(raw, "data.items", {"title": "title", "external_id": "id", "path": "links.self"}, "https://a.org/i/{external_id}")
    got = items.collect()
    assert [(r.fields.get("title"), r.source_url) for r in got] == [("T", "https://a.org/i/5"), (None, "https://a.org/i/")] and rejects.count() == 1
    docs = listings.json_documents(items, "files").collect()
    assert [(d.document_url, d.document_title) for d in docs] == [("https://a.org/f.pdf", "F")]
    posts = spark.createDataFrame([(1, "https://w.org/", json.dumps([{"id": 3, "date": "2026-01-02T03:04:05", "link": "https://w.org/p/3", "title": {"rendered": "<b>Bid</b>"}, "content": {"rendered": '<p>See <a href="/d/a.pdf">A</a> and <a href="b.html">B</a></p>'}, "excerpt": {"rendered": ""}}])), (1, "https://w.org/e", '{"code": "rest_no_route"}')], "source_id bigint, url string, body string")
    items, rejects = listings.wordpress_items(posts)
    r = items.first()
    assert r.fields["title"] == "Bid" and r.fields["description"] == "See A and B" and [d.url for d in r.documents] == ["https://w.org/d/a.pdf"]
    assert [x.code for x in rejects.collect()] == ["rest_no_route"]
    package = {"releases": [{"ocid": "o1", "date": "2026-01-01", "parties": [{"name": "P", "roles": ["buyer"]}], "tender": {"id": "T1", "title": "X", "status": "cancelled", "procurementMethodDetails": "Request for Quotation", "value": {"amount": 12.5, "currency": "ZAR"}, "milestones": [{"title": "Site briefing", "dueDate": "2026-02-01"}], "documents": [{"url": "u", "title": "a"}, {"url": "u", "title": "b"}]}}]}
    items, rejects = listings.ocds_items(spark.createDataFrame([(1, "https://o.org/", json.dumps(package)), (1, "https://o.org/2", "[]")], "source_id bigint, url string, body string"))
    f = items.first()
    assert (f.fields["status"], f.fields["procurement_type"], f.fields["organization"], f.fields["briefing_date"], len(f.documents)) == ("CANCELLED", "RFQ", "P", "2026-02-01", 1) and rejects.count() == 1


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    r = random.Random(4)
    plain = ['<tr class="t">', "<tr>", "</tr>", "<td>", "</td>", '<td class="ref x">', '<a href="/x">', "</a>", "text", " ", "\n", "<br>", "é"]
    bits = [*plain, "<br />", "&amp;", "<!-- c -->", "<p", "<TD>", ">", '"', "<a href=x>", "<script>", "</script>", "<title>", "<", "</td >"]
    fed, feed = [], pages._Rows.feed
    monkeypatch.setattr(pages._Rows, "feed", lambda parser, html: fed.append(html) or feed(parser, html))

    def rows(read, html):
        parser = pages._Rows("tr", "t")
        try:
            read(parser, html)
        except IndexError as e:  # a cell that was opened in a row that has ended
            return repr(e)
        return parser.rows

    for k in (len(plain), len(bits)):
        for _ in range(3000):
            html = "".join(r.choice(bits[:k]) for _ in range(r.randrange(14)))
            assert rows(pages._feed, html) == rows(feed, html), html
        assert bool(fed) == (k > len(plain))  # plain pages are not fed to HTMLParser


def test_pages(spark):
    html = '<table><tr class="row"><td>R1</td><td><a href="/t/1">Road signs</a></td><td class="c">15/09/2026</td></tr><tr><td>skip</td></tr><tr class="row"><td>R2</td><td>No link</td></tr></table><a href="a.PDF?x=1">Spec SCM/2026/1</a>'
    p = spark.createDataFrame([(1, 1, "https://a.org/d/", html), (2, 1, "https://a.org/e", None)], "page_id bigint, source_id bigint, url string, html string")
    rules = spark.createDataFrame([(1, "tr", "row", {"reference": "0", "closing": "td.c"})], "source_id bigint, row_tag string, row_class string, fields map<string,string>")
    got = sorted((r.fields["reference"], r.fields["title"], r.fields.get("closing"), tuple(r.links)) for r in pages.html_listing_items(p, rules).collect())
    assert got == [("R1", "Road signs", "15/09/2026", ("https://a.org/t/1",)), ("R2", "R2 No link", None, ())]
    links = {(r.link_url, r.link_text) for r in pages.page_links(p).collect()}
    assert links == {("https://a.org/t/1", "Road signs"), ("https://a.org/d/a.PDF?x=1", "Spec SCM/2026/1")}
    assert pages.pdf_link_items(p).first().fields["reference_number"].startswith("SCM/2026")
    chain = spark.createDataFrame([("a", "b", True), ("b", "c", False), ("c", "a", False)], "url string, next_url string, is_first boolean")
    assert [r.url for r in pages.listing_chain(chain).orderBy("depth").collect()] == ["a", "b", "c"]
    items = spark.createDataFrame([("u", {"title": "T"}, [("d1",)]), ("v", {"title": "V"}, [])], "source_url string, fields map<string,string>, documents array<struct<url:string>>")
    details = spark.createDataFrame([("u", {"title": "no", "description": "D"}, [("d1",), ("d2",)])], "url string, fields map<string,string>, documents array<struct<url:string>>")
    out = {r.source_url: r for r in pages.enrich_from_detail(items, details).collect()}
    assert out["u"].fields == {"title": "T", "description": "D"} and len(out["u"].documents) == 2 and out["v"].fields == {"title": "V"}


def test_documents(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.html").write_text("<html><script>no</script><p>yes</p></html>")
    (tmp_path / "d.bin").write_bytes(b"\x01\x02")
    (tmp_path / "e.txt").write_text("")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one &amp; two</w:t></w:p>")
    good, bad = documents.read_documents(spark, str(tmp_path))
    assert [r.code for r in bad.collect()] == ["FORMAT_NOT_ALLOWED"]  # Spark lists no files of zero bytes
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.method) for r in documents.extract_text(good).collect()}
    assert got == {"a.txt": ("hello", "PLAIN_TEXT"), "b.csv": ("x | y\n1 | 2", "SPREADSHEET"), "c.html": ("yes", "HTML_PARSE"), "f.docx": ("one & two", "PLAIN_TEXT")}


def test_state(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    b = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id int, x string, y int")
    assert sorted(map(tuple, state.upsert(a, b, ["id"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    assert sorted(map(tuple, state.upsert(a, b, ["id"], protect_null=False).collect()), key=str) == [(1, "a", 1), (2, None, 5), (3, "c", 6)]
    for _ in range(2):
        state.write_tables({"opportunities": a, "events": b}, str(tmp_path / "t"), "7")
    assert spark.read.parquet(str(tmp_path / "t/events")).count() == 2
    kept, store = state.offload_payload(spark.createDataFrame([("x" * 10,), ("x" * 10,), ("y",), (None,)], "p string"), "p", 5)
    assert store.count() == 1 and kept.where("payload_key IS NOT NULL AND p IS NULL").count() == 2
    with pytest.raises(ValueError):
        reference.import_municipalities(a, a, a)
    rows = spark.createDataFrame([("S", "https://s.org/", "HTML", None, None, None), ("T", "http://10.0.0.1/", "HTML", None, None, None), ("U", "https://u.org/", "FAX", None, None, None)], "name string, base_url string, connector string, municipality_code string, slug string, scope string")
    ok, skipped = reference.import_sources(rows, ["HTML"], spark.createDataFrame([(1, "M1")], "id bigint, code string"))
    assert [(r.slug, r.scope) for r in ok.collect()] == [("s", "NATIONAL")] and sorted(r.reason for r in skipped.collect()) == ["connector", "url: private"]


def test_exact_layers_look_at_no_title(spark, monkeypatch):
    from procyon.operators import dedup
    from procyon.plans.registry import QUERIES

    monkeypatch.setattr(dedup, "similar_pairs", lambda *a, **k: pytest.fail("titles were joined"))
    rows = QUERIES["d7_exact_layers"](spark, "/root/testdata/sf0.001").collect()
    assert {r.layer for r in rows} <= {1, 2, 3} and sum(r.n for r in rows) > 0


def test_candidates_are_shuffled_once(spark):
    """Each of the tables that layer 3 joins is dealt out once, and the incoming rows once more by reference."""
    day, seen = "2026-03-01 10:00:00", "2026-01-01 00:00:00"
    old = records(spark, [(1, "A/1", "First", 1, 7, day, "Org", "RFQ", seen), (2, None, "First", 2, 8, day, "Org", "RFQ", seen)])
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    was = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        plan = dedup.dedup_fingerprint(old, old)._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, x in zip(names, was, strict=True):
            spark.conf.set(n, x)
    assert plan.count("Exchange hashpartitioning") <= 5


def test_hashes_that_are_none_are_compared_as_they_are(spark):
    day, seen = "2026-03-01 10:00:00", "2026-01-01 00:00:00"
    hexed = "ab" * 32
    rows = records(spark, [(i, None, f"Title {i}", 1, 7, day, "Org", "RFQ", seen) for i in range(1, 7)])
    marks = F.create_map(*[F.lit(x) for kv in enumerate([hexed, hexed.upper(), hexed + "\n", "x", bytes(range(97, 129)).decode("latin-1"), None], 1) for x in kv])
    old = rows.withColumn("content_hash", marks[F.col("id").cast("int")]).withColumn("fingerprint", F.lit(None).cast("string"))
    new = old.withColumn("id", F.col("id") + 10)
    got = {r.id: r.existing_id for r in dedup.resolve_exact(new, old).where("layer = 2").collect()}
    assert got == {11: 1, 12: 2, 13: 3, 14: 4, 15: 5}
    kept = dict(dedup._used(old).dtypes)
    assert kept["content_hash"] == kept["fingerprint"] == "binary"


def test_repeated_ids_are_refused_before_they_multiply(spark):
    point = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (3, 1), (4, 3), (5, 4)], "id bigint, root bigint")
    with pytest.raises(ValueError, match="repeated"):
        dedup.jump(point)
    assert {r.id: r.root for r in dedup.jump(point.where("id != 3 OR root = 2")).collect()} == dict.fromkeys(range(1, 6), 1)
