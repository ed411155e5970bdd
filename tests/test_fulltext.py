"""The stored index against plain loops over the texts, and the stemmer against published stems."""

import itertools
import math
import random
import re

import pytest

from procyon.functions.stemming import stem_word
from procyon.operators import fulltext

#: Published pairs of words and stems.
STEMS = """consigned consign consignment consign consistency consist consolatory consolatori consolingly consol conspicuous conspicu conspirators conspir constancy constanc knackeries knackeri knavish knavish kneeling kneel
knightly knight knitted knit knives knive knockers knocker hopping hop hoping hope happy happi cry cri by by say say ties tie cries cri gas gas this this gaps gap kiwis kiwi generously generous general general
communities communiti dying die skis ski news news inning inning exceed exceed luxuriated luxuri relational relat organization organ national nation biology biolog bed bed agreed agre services servic municipality municip""".split()


def test_stems():
    for word, stem in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert stem_word(word) == stem
    assert [stem_word(w) for w in ("a", "ab", "été", "12kva", "")] == ["a", "ab", "été", "12kva", ""]


def plain_rank(positions):
    if len(positions) == 1:
        return 0.1 * sum(1 / (j * j) for j in range(1, len(positions[0]) + 1)) / (math.pi**2 / 6)
    out = 1.0
    for a, b in itertools.combinations(positions, 2):
        for p, q in itertools.product(a, b):
            d = abs(p - q)
            out *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    return 1 - out


def plain_search(rows, q):
    terms, out = fulltext.query_terms(q), {}
    for i, text in rows:
        words = [stem_word(w) if w not in fulltext.STOP else None for w in re.findall(r"[^\W_]+", (text or "").lower())]
        at = [[min(p, 16383) for p, w in enumerate(words, 1) if w == t][:256] for t in terms]
        if all(at):
            out[i] = plain_rank(at)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    words = ["road", "roads", "sign", "signs", "the", "repair", "pump", "of", "pumping", "library"]
    rows = [(i, " ".join(r.choice(words[: 3 + i % 8]) for _ in range(r.choice([3, 8, 60])))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, "road " * 400), (903, "solar inverter supply, solar inverter installation"), (904, "Solar water heating"), (905, "road " * 17_000 + "inverters")]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    per = fulltext.PER_RANGE
    fulltext.PER_RANGE = 5  # so that a common term is many blocks
    fulltext.write_index(spark.createDataFrame(rows, "id bigint, body string").repartition(3), "body", path)
    fulltext.PER_RANGE = per
    return fulltext.Index(spark, path)


@pytest.mark.parametrize("q", ["roads", "the road signs", "solar inverters", "repairing pumps library", "nothing", "inverter"])
def test_search_equals_plain(index, rows, q):
    got = {r.key: r.rank for r in index.search(q).collect()}
    want = plain_search(rows, q)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)


def test_known_ranks(index):
    """Values as PostgreSQL gives them: 0.0607927 for one occurrence, more for several and for terms side by side."""
    ranks = {r.key: r.rank for r in index.search("solar").collect()}
    assert ranks[904] == pytest.approx(0.06079271, abs=1e-7) and ranks[903] == pytest.approx(0.07599089, abs=1e-7)
    assert [r.key for r in index.search("solar inverters").collect()] == [903]
    assert plain_rank([[1], [2]]) == pytest.approx(0.09910322, abs=2e-6)


@pytest.mark.parametrize("q", ["road", "road sign"])
def test_top_skips_blocks_and_loses_nothing(index, rows, q, monkeypatch):
    monkeypatch.setattr(fulltext, "WAVE", 3)
    read = []
    got = [(r.key, round(r.rank, 7)) for r in index.search_top(q, 4, read.append).collect()]
    want = sorted(((-round(x, 9), i) for i, x in plain_search(rows, q).items()))[:4]
    assert got == [(i, round(-x, 7)) for x, i in want]
    assert 3 <= read[0] < index.bounds(index.terms(q)).count()
    assert index.search_top("the of", 4).count() == 0


def test_boolean_search_and_the_folders_it_reads(index, rows):
    has = lambda text, *stems: {stem_word(w) for w in re.findall(r"[^\W_]+", (text or "").lower())} & set(stems)
    got = {r.key for r in index.search_any([["pumps", "sig*"], ["solar"]]).collect()}
    assert got == {i for i, t in rows if (has(t, "pump") and has(t, "sign")) or has(t, "solar")}
    folders = {re.search(r"folder=(\d+)", f)[1] for f in index.blocks(["road"]).inputFiles()}
    assert len(folders) == 1 and len(index.folders) > 3
    assert {r.term for r in index.blocks(["s*"]).select("term").distinct().collect()} == {"sign", "solar", "suppli"}


def test_empty_table(spark, tmp_path):
    fulltext.write_index(spark.createDataFrame([], "id bigint, body string"), "body", str(tmp_path))
    empty = fulltext.Index(spark, str(tmp_path))
    assert empty.search("road").collect() == [] and empty.search_top("road sign").collect() == [] and empty.search_any([["r*"]]).collect() == []


def test_ranges_are_bounded_by_bytes_and_equal_keys_are_one_document(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "RANGE_BYTES", 20_000)  # so that long texts make more ranges than PER_RANGE would
    twice = [*rows, (7, "road library road"), (None, "road"), (None, "signs road")]
    fulltext.write_index(spark.createDataFrame(twice, "id bigint, body string").repartition(5), "body", str(tmp_path))
    stored = fulltext.Index(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/about").first()["ranges"] == -(-sum(len(t or "") for _, t in twice) // 20_000) > 1
    docs = stored.blocks(["road"]).selectExpr("range", "most", "explode(docs) AS d").select("range", "most", "d.*").collect()
    at = {}
    for i, text in twice:
        found = [p for p, w in enumerate(re.findall(r"\w+", (text or "").lower()), 1) if w in ("road", "roads")]
        at[i] = sorted(at.get(i, []) + [min(p, fulltext.LAST_POSITION) for p in found])
    assert len(docs) == len({d.key for d in docs}) and {d.key: d.positions for d in docs} == {i: p[:256] for i, p in at.items() if p}
    assert {d.range: d.most for d in docs} == {d.range: max(len(x.positions) for x in docs if x.range == d.range) for d in docs}
