"""Column expressions on literal cases."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from procyon.functions import dates, hashing, registry, text, urls


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "value", "has_time"),
    [
        ("2026-09-15", datetime(2026, 9, 14, 22), False),
        ("2026-09-15T11:00:00Z", datetime(2026, 9, 15, 11), True),
        ("2026-09-15T11:00:00+05:30", datetime(2026, 9, 15, 5, 30), True),
        ("2026-09-15 11:00", datetime(2026, 9, 15, 9), True),
        ("15/09/2026", datetime(2026, 9, 14, 22), False),
        ("09/15/2026", None, False),
        ("05-09-2026 2:30 pm", datetime(2026, 9, 5, 12, 30), True),
        ("Closing 15th September 2026 at 11h00", datetime(2026, 9, 15, 9), True),
        ("September 15, 2026", datetime(2026, 9, 14, 22), False),
        ("15 Sept 2026", datetime(2026, 9, 14, 22), False),
        ("15 Foo 2026", None, False),
        ("31 February 2026", None, False),
        ("to be confirmed", None, False),
        ("", None, False),
        (None, None, False),
    ],
)
def test_parse_datetime(spark, raw, value, has_time):
    got = one(spark, dates.parse_datetime(F.lit(raw).cast("string")))
    assert got["value"] == value and got["has_time"] == has_time and got["raw"] == raw


def test_closing_dates_end_the_day(spark):
    assert one(spark, dates.parse_closing_datetime(F.lit("15 September 2026")))["value"] == datetime(2026, 9, 15, 21, 59, 59)
    assert one(spark, dates.parse_closing_datetime(F.lit("2026-09-15")))["value"] == datetime(2026, 9, 14, 22)
    assert one(spark, dates.parse_closing_datetime(F.lit("2026-09-15"), iso_end_of_day=True))["value"] == datetime(2026, 9, 15, 21, 59, 59)


@pytest.mark.parametrize(("raw", "want"), [("R 1 250 000.00", ("ZAR", "1250000.00")), ("ZAR 45,000", ("ZAR", "45000.00")), ("about R1,234.56 excl VAT", ("ZAR", "1234.56")), ("€ 1.234,56", ("EUR", "1234.56")), ("$ 12,50", ("USD", "12.50")), ("none", None), (None, None)])
def test_parse_money(spark, raw, want):
    got = one(spark, text.parse_money(F.lit(raw).cast("string")))
    assert (got and (got["currency"], got["amount"])) == (want and (want[0], Decimal(want[1])))


@pytest.mark.parametrize(("raw", "want"), [("scm/2026/001", "SCM/2026/001"), (" SCM--2026//001 ", "SCM/2026/001"), ("S C M 1", "SCM1"), ("", None), (None, None), ("ＳＣＭ-1", "SCM-1")])
def test_normalize_reference(spark, raw, want):
    assert one(spark, text.normalize_reference(F.lit(raw).cast("string"))) == want


def test_text(spark):
    assert one(spark, text.clean_text(F.lit(" a\x00\t b  c \r\n\n\n\n d ﬁ "))) == "a b c\n\nd fi"
    assert one(spark, text.clean_text(F.lit(" \n "))) is None
    assert one(spark, text.clean_text(F.lit("abc def"), 4)) == "abc"
    assert one(spark, text.truncate_words(F.lit("one two three"), 9)) == "one two…"
    assert one(spark, text.truncate_words(F.lit("one two"), 9)) == "one two"
    assert one(spark, text.extract_emails(F.lit("A@B.co.za, a@b.co.za x@y"))) == ["a@b.co.za"]
    assert one(spark, text.extract_phones(F.lit("call 011 123 4567 or +27 11 123-4567"))) == ["0111234567", "+27111234567"]
    assert one(spark, text.slugify(F.lit(" Élan Vital / №5 "))) == "elan-vital-5"
    assert one(spark, text.strip_html(F.lit("<b>a</b><i>b</i>"))) == "a b"
    assert one(spark, text.first_meaningful_line(F.lit("x\n this is a longer line \n y"))) == "this is a longer line"
    assert one(spark, text.visible_text(F.lit("<style>p{}</style><p>a &amp; b</p><!-- no --><script>1</script>"))) == "a & b"


def test_trigram_similarity(spark):
    assert one(spark, text.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, text.trigram_similarity(F.lit("Supply of road signs"), F.lit("supply of ROAD signs"))) == 1.0
    assert one(spark, text.trigram_similarity(F.lit(""), F.lit(None).cast("string"))) == 0.0


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://Example.ORG:80", "http://example.org/"), ("https://a.org:443/x?utm_source=1&b=2#f", "https://a.org/x?b=2"), ("https://a.org:8443/", "https://a.org:8443/"), ("https://u:p@a.org/", None), ("ftp://a.org/", None), ("/docs/../x.pdf", "https://base.org/x.pdf"), ("y.html", "https://base.org/d/y.html"), ("//c.org/z", "https://c.org/z"), ("", None), (None, None)],
)
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.lit(url).cast("string"), F.lit("https://base.org/d/index.html"))) == want


@pytest.mark.parametrize(("url", "reason"), [("https://a.org/", None), ("ftp://a.org/", "scheme"), ("http://", "host"), ("http://u@a.org/", "credentials"), ("http://a.org:22/", "port"), ("http://localhost/", "local"), ("http://10.1.2.3/", "private"), ("http://169.254.169.254/x", "private"), ("http://8.8.8.8/", None), (None, "empty")])
def test_url_policy(spark, url, reason):
    got = one(spark, urls.url_policy(F.lit(url).cast("string")))
    assert got["reason"] == reason and got["ok"] == (reason is None)


def test_formats(spark):
    sniff = lambda head, kind=None, name="x": one(spark, urls.sniff_format(F.lit(head), F.lit(kind).cast("string"), F.lit(name)))
    assert sniff(b"%PDF-1.4") == "PDF" and sniff(b"PK\x03\x04abc", None, "a.docx") == "DOCX" and sniff(b"PK\x03\x04abc") == "ZIP" and sniff(b"PK\x03\x04abc", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet") == "XLSX"
    assert sniff(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", None, "a.xls") == "XLS" and sniff(b"  <!DOCTYPE HTML>") == "HTML" and sniff(b"a,b", "text/csv") == "CSV" and sniff(b"??") == "UNKNOWN"


def test_hashes(spark):
    f = lambda *a: one(spark, hashing.fingerprint(*[F.lit(x) for x in a[:2]], F.lit(a[2]).cast("timestamp_ntz"), F.lit(a[3])))
    assert f("Road  Signs!", "City", "2026-09-15 09:00:00", "RFQ") == f("road signs", "city", "2026-09-15 21:00:00", "RFQ") != f("road signs", "city", "2026-09-16 09:00:00", "RFQ")
    c = lambda phone: one(spark, hashing.contact_fingerprint(F.lit("A"), F.lit("a@b.c"), F.lit(phone), F.lit(None).cast("string")))
    assert c("+27 11 123 4567") == c("011 123 4567") != c("011 123 4568")


def test_sql_functions(spark):
    assert "trigram_similarity" in registry.register_functions(spark)
    row = spark.sql("SELECT normalize_reference(' a--1 ') AS a, is_http_url('ftp://x') AS b, trigram_similarity('word', 'two words') AS c, nfkc('ﬁ') AS d").first()
    assert (row.a, row.b, row.d) == ("A/1", False, "fi") and row.c == pytest.approx(4 / 11)


def test_cleaning_by_the_short_way_is_that_by_the_long_one(spark):
    import re

    from procyon.functions.text import CLEANING

    def plain(t, most):
        for pattern, instead in CLEANING:
            t = re.sub(pattern.replace("\\x{00A0}", "\xa0"), instead, t)
        return re.sub(r"\s+$", "", t[:most]) or None

    texts = ["", " ", "   ", "a", "  a b  ", "a  b", " a\tb ", "a\xa0b", "a\x00b", "a\n\n\n\nb\r\n", "é ", "abcd efgh ij", "abcd     efgh", "\x0ba ", "abcdefghi\x0bj"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.clean_text(F.col("t"), 10).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: plain(t, 10) for i, t in enumerate(texts)}


def test_values_go_to_python_as_texts(spark):
    rows = [(1, {"a": "ﬁ\n\"x\"", "b": None, "c": "①\x01"}), (2, {"a": "plain"}), (3, {}), (4, None)]
    df = spark.createDataFrame(rows, "i int, m map<string,string>").repartition(2).select("i", text.nfkc_values(F.col("m")).alias("m"))
    assert {r.i: r.m for r in df.collect()} == {1: {"a": "fi\n\"x\"", "b": None, "c": "1\x01"}, 2: {"a": "plain"}, 3: {}, 4: None}
    (udf,) = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "ArrowEvalPython" in line]
    assert "StructsToJson" in udf  # no column of maps, whose Arrow form costs every row


def test_dates_of_odd_blanks_and_missing_parts(spark):
    cases = {"1st March 2024  at 09:30": "2024-03-01 07:30:00", " 05/03/2024 10h15 ": "2024-03-05 08:15:00", "March 5, 2024": "2024-03-04 22:00:00", "13/31/2024 and 5 May 2024": "2024-05-04 22:00:00", "31/12/2023\xa09:05:07 pm": "2023-12-31 19:05:07", "12/31/2023": None, "05/13/2024 x 5 May 2024": "2024-05-04 22:00:00", "": None, "none": None, "Sat 5 May 2024": "2024-05-04 22:00:00"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("t", F.col("i"), dates.parse_datetime(F.col("t"))["value"].cast("string").alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases
